import random

from tessera.llm import subjects as s

WORDS = {t: [f"{t}word{chr(97 + i)}" for i in range(12)] for t in ("law", "food", "sport")}
COMMON = [f"filler{chr(97 + i)}" for i in range(20)]


def sentence(rng, topic):
    w = [rng.choice(COMMON) for _ in range(6)] + [rng.choice(WORDS[topic]) for _ in range(2)]
    rng.shuffle(w)
    return " ".join(w).capitalize() + "."


def corpus(n, seed):
    rng = random.Random(seed)
    docs, true = [], {}
    for i in range(n):
        topics = rng.sample(list(WORDS), rng.choice([1, 1, 1, 2]))
        text = [f"# {rng.choice(WORDS[topics[0]])}\n"] if rng.random() < 0.4 else []
        for t in topics:
            text += [sentence(rng, t) for _ in range(6)]
        if rng.random() < 0.2:
            text.append(sentence(rng, rng.choice([t for t in WORDS if t not in topics])))
        docs.append((i, " ".join(text), "x"))
        true[i] = set(topics)
    return docs, true


def test_held_out_accuracy(spark):
    docs, true = corpus(500, 3)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, " \n ", "x"), (1003, "123 456", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    labels = [(i, t, "ann") for i in range(0, 300) for t in sorted(true[i])] + [(0, sorted(true[0])[0], "bob"), (9999, "law", "ann"), (None, "law", "ann")]
    model = s.train_on(df, spark.createDataFrame(labels, "doc_id long, subject string, annotator string"))
    got = {}
    for r in s.classify(df, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {1000, 1001, 1002, 1003} & set(got)
    held = range(300, 500)
    assert sum(got[i] == true[i] for i in held) >= 0.93 * len(held)


def test_no_labels_no_documents(spark):
    df = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    assert s.train_on(df, none) is None and s.classify(df, None).count() == 0
    one = s.train_on(df, spark.createDataFrame([(1, "law", "a")], "doc_id long, subject string, annotator string"))
    assert [r.subject for r in s.classify(df, one).collect()] == ["law"] and s.classify(df.limit(0), one).count() == 0
