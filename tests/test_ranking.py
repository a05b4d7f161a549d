import random

from tessera.plans.ranking import numbered


def test_numbers_in_groups_of_any_size(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, 1, 2]), i, f"x{i}") for i in range(5_000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "g string, h int, i long, text string").repartition(7)
    got = {r.i: r for r in numbered(df, ["g", "h"], ["i"], "n", ("text", "i")).collect()}
    seen: dict = {}
    for g, h, i, text in rows:
        n, before = seen.get((g, h), (0, (None, None)))
        assert (got[i].n, (got[i].previous_text, got[i].previous_i)) == (n + 1, before)
        seen[g, h] = (n + 1, (text, i))
    assert numbered(df.limit(0), ["g"], ["i"], "n").count() == 0
