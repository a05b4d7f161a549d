"""Variant spellings of names: normal forms, phonetic blocks, Jaro-Winkler with a nickname table, components.

Each spelling gets a normal form. Persons: given name (nicknames replaced by what they are short for)
and surname, whatever the order, title, middle initial, case, accent or punctuation. Everything else:
the set of common words (trades, product lines, kinds of places; legal forms are dropped,
abbreviations written out), the set of own words, and a version number. Which words are common is
learned: those that occur in many namespaces.

Forms meet in blocks of phonetic codes: the classes of a word's consonants, and the same with one of them
left out, so that any one typing error leaves a block in common; long words, which may hold two, also meet by
their first and last letters, as one end holds one error at most. A block of more than CROWD forms is cut up: its words meet by
their spellings with one letter left out, or two in long words, instead. Words of a similarity of SURE, however many
typing errors that takes, meet by keys of their own (sure_codes), which no such pair escapes. Forms that meet are linked if
common words and version are equal and own words are alike: by a Jaro-Winkler similarity of SURE, or of
LEAST and no more typing errors than a word of this length may hold. Aliases link the spellings of one row. Components of the
links are things. Short forms that name no thing by themselves (an initial and a surname, initials of
an organisation) join a thing if it is the only one in the namespace that fits, or the only one that
uses them as an alias, or the only one of the row's city; else they are linked with equal forms only.

Defined results: null and blank names are skipped, and rows with nothing else stand alone; an id
delivered twice counts once; rows of different namespaces are never linked; null namespaces are one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.plans.lineage import written

#: Short and familiar forms of given names.
NICKNAMES = {
    k: tuple(v.split())
    for k, v in {
        "abby": "abigail", "al": "albert alan alfred", "alex": "alexander alexandra", "andy": "andrew", "art": "arthur", "barb": "barbara", "becca": "rebecca", "becky": "rebecca", "ben": "benjamin",
        "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles",
        "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard",
        "don": "donald", "doug": "douglas", "ed": "edward", "eddie": "edward", "frank": "francis franklin", "fred": "frederick", "gene": "eugene", "greg": "gregory", "hal": "henry harold",
        "hank": "henry", "harry": "henry harold", "jack": "john", "jake": "jacob", "jamie": "james", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jess": "jessica",
        "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth",
        "larry": "lawrence", "len": "leonard", "liz": "elizabeth", "lou": "louis", "maggie": "margaret", "mandy": "amanda", "matt": "matthew", "max": "maximilian maxwell", "meg": "margaret",
        "mick": "michael", "mike": "michael", "nate": "nathan nathaniel", "ned": "edward", "nick": "nicholas", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret",
        "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra",
        "steve": "stephen steven", "sue": "susan", "susie": "susan", "ted": "edward theodore", "terry": "terence", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
        "trish": "patricia", "vicky": "victoria", "walt": "walter", "will": "william", "zach": "zachary",
    }.items()
}
#: Titles, legal forms, abbreviations of common words, words without weight.
TITLES = frozenset("dr prof mr mrs ms miss sir professor doctor".split())
LEGAL = frozenset("company co group grp incorporated inc gmbh corporation corp limited ltd plc llc ag sa".split())
SHORT = {
    "eng": "engineering", "log": "logistics", "pharma": "pharmaceuticals", "univ": "university", "inst": "institute", "sys": "systems", "labs": "laboratories", "lab": "laboratories",
    "shpg": "shipping", "publ": "publishing", "pub": "publishing", "ins": "insurance", "coop": "cooperative", "ft": "fort", "pt": "port", "st": "saint", "mt": "mount", "natl": "national", "intl": "international",
}
LIGHT = frozenset("the and by of".split())
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "&": " and ", "’": "'"})
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*)")
_SEP = "\x1f"
#: Jaro-Winkler similarities that decide alone, and below which words differ; letters from which a word may hold two errors.
SURE, LEAST, LONG_WORD = 0.93, 0.82, 9
#: Groups of names that stand for namespaces where there are too few.
GROUPS = 64
#: Forms that are compared within one block.
CROWD = 200


def folded(text: str) -> str:
    text = text.lower().translate(_LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


_SOUND = {c: d for d, cs in enumerate(("", "bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in cs}


def phonetic(word: str, joined: bool = False) -> str:
    """Classes of the consonants; `joined`: successive ones of one class count once."""
    out, last = [], None
    for c in word:
        d = _SOUND.get(c)
        if d is not None and not (joined and d == last):
            out.append(str(d))
        last = d
    return "".join(out)


def close(a: str, b: str) -> bool:
    """Own words that typing errors set apart."""
    if a == b:
        return True
    # which of several equal letters are matched may depend on the order
    similar = max(jaro_winkler(a, b), jaro_winkler(b, a))
    if similar >= SURE:
        return True
    n = min(len(a), len(b))
    most = 2 if n >= LONG_WORD else 1
    return n >= 4 and similar >= LEAST and edits(a, b, most) <= most


def codes(word: str) -> list[str]:
    """Keys of the blocks that a word is in."""
    sound = phonetic(word) or word[:1]
    out = [f"S{sound}", *(f"S{sound[:i]}{sound[i + 1 :]}" for i in range(len(sound)))]
    if len(word) >= LONG_WORD:
        # the first four letters and the last four don't meet, so of two errors one at most is in either
        for end, part in (("L", word[:4]), ("R", word[-4:])):
            out += [f"{end}{part[:i]}{part[i + 1 :]}" for i in range(4)]
    return list(dict.fromkeys(out))


#: Letters that both words begin with, and what Jaro-Winkler then leaves for a similarity of SURE: the shares of letters without a partner, of both words.
_LEFT_OVER = {p: 3 * (1 - (SURE - 0.1 * p) / (1 - 0.1 * p)) + 1e-9 for p in range(4)}
_RANK = {c: i for i, c in enumerate("eaitnorslucdmhpgbvfwykzjxq")}


def sure_codes(word: str) -> list[str]:
    """Keys of which any two different words with a similarity of SURE have one in common.

    Words that begin with three letters alike meet by these. Of others so few letters have no partner, less than a
    share of the longer word's, that if the alphabet is dealt into one group more, a group's letters are the same in both."""
    if len(word) < 3:
        return []
    out, n = [f"3{word[:3]}"], len(word)
    for p in range(3):
        left = _LEFT_OVER[p]
        for groups in sorted({int(left * longer) + 1 for longer in range(n, int(n / (1 - left)) + 1)}):
            dealt = [""] * groups
            for c in sorted(word[p:]):
                dealt[_RANK.get(c, ord(c)) % groups] += c
            out += [f"{p}{word[:p]}{_SEP}{groups}.{g}{_SEP}{cs}" for g, cs in enumerate(dealt)]
    return out


def _shortened(word: str) -> list[str]:
    """The word, and with one letter left out: words one typing error apart have one in common."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


_LONG_LEGAL: dict[str, list[str]] = {}
for _w in sorted(LEGAL):
    for _x in _shortened(_w) if len(_w) >= 6 else ():
        _LONG_LEGAL.setdefault(_x, []).append(_w)


def _is_near_legal(word: str) -> bool:
    """True for a long legal form with a typing error."""
    return any(edits(word, x, 1) <= 1 for part in _shortened(word) for x in _LONG_LEGAL.get(part, ()))


class Forms:
    """Normal forms, given the common words, the established given names, and the common words that names of a kind begin with."""

    def __init__(self, common: frozenset[str], given: frozenset[str], leading: dict[str, frozenset[str]] | None = None) -> None:
        # an initial in front of a name of this kind stands for the only such word that begins with it
        starts = {k: Counter(w[0] for w in ws) for k, ws in (leading or {}).items()}
        self.initial = {(k, w[0]): w for k, ws in (leading or {}).items() for w in ws if starts[k][w[0]] == 1}
        self.common, self.given = common, given | frozenset(x for v in NICKNAMES.values() for x in v)
        self._snap: dict[str, str | None] = {}
        self._near: dict[str, set[str]] = {}
        for c in common:
            for x in _shortened(c) if len(c) >= 4 else ():
                self._near.setdefault(x, set()).add(c)

    def snap(self, word: str) -> str | None:
        """The common word that `word` is, or is one typing error away from."""
        if word in self.common:
            return word
        if word not in self._snap:
            met = set().union(*(self._near.get(x, ()) for x in _shortened(word))) if len(word) >= 4 else ()
            near = [c for c in met if edits(word, c, 1) <= 1]
            if len(self._snap) > 200_000:
                self._snap.clear()
            self._snap[word] = near[0] if len(near) == 1 else None
        return self._snap[word]

    def parse(self, text: str, kind: str | None) -> tuple[str, list[tuple[str, str]], str]:
        """(form, words to meet by with the group each meets in, initials). Forms: P person, W initial and surname, G other, I initials; '' is none."""
        raw = text.strip()
        bare = raw.replace(".", "").replace(" ", "")
        if 2 <= len(bare) <= 5 and bare.isalpha() and bare.isupper() and (
            ("." in raw and len(bare) * 2 in (len(raw), len(raw) + 1)) or (raw == bare and kind != "person")
        ):
            return f"I{_SEP}{folded(bare)}", [], ""
        spaced = re.sub(r"(?<=[a-zß-öø-ÿ]{3})(?=[A-ZÀ-ÖØ-Þ][a-z])", " ", raw)
        low = re.sub(r"\bco-op\b", "coop", folded(spaced))
        low = re.sub(r"\bg\.?m\.?b\.?h\b\.?", "gmbh", low)
        versions = [m[1] for t in re.split(r"[\s,\-_]+", low) if (m := _VERSION.fullmatch(t.strip(".")))]
        words = [w for w in re.findall(r"[^\W\d_]+", re.sub(r"\bv?\d+(?:\.\d+)*\b", " ", low.replace("'", "")))]
        if not words:
            return "", [], ""
        content = [SHORT.get(w, w) for w in words if w not in LIGHT]
        legal = [w for w in content if w in LEGAL or (len(w) >= 6 and _is_near_legal(w))]
        if len(content) == 2 and not self.snap(content[1]):
            content[0] = self.initial.get((kind, content[0]), content[0])
        # a surname may look like a common word with a typing error
        snapped = [(w, self.snap(w) if kind != "person" or w in self.common else None) for w in content if w not in legal]
        if versions or legal or any(s for _, s in snapped) or kind == "location" or "and" in words or len(words) == 1:
            return self._other(snapped, versions)
        return self._person(low, words) or self._other(snapped, versions)

    def _other(self, snapped: list[tuple[str, str | None]], versions: list[str]) -> tuple[str, list[tuple[str, str]], str]:
        own: list[str] = []
        common: list[str] = []
        joined = versions or not any(s for _, s in snapped)  # the last word may be written without a space before it
        for w, s in snapped:
            if s:
                common.append(s)
                continue
            tail = next((c for c in self.common if len(c) >= 4 and len(w) >= len(c) + 3 and w.endswith(c)), None) if joined else None
            if tail:
                own.append(w[: -len(tail)])
                common.append(tail)
            else:
                own.append(w)
        version = re.sub(r"(?:\.0+)+$", "", versions[-1]) if versions else ""
        initials = "".join(w[0] for w, _ in snapped) if len(snapped) > 1 else ""
        own.sort()
        base = f"{' '.join(sorted(common))}{_SEP}{version}"
        met = [(f"{base}{_SEP}{len(own)}", w) for w in dict.fromkeys(own or [""])]
        return f"G{_SEP}{base}{_SEP}{' '.join(own)}", met, initials if not versions else ""

    def _person(self, low: str, words: list[str]) -> tuple[str, list[tuple[str, str]], str] | None:
        words = [w for w in words if w not in TITLES and w not in LIGHT]
        if not 2 <= len(words) <= 4:
            return None
        if "," in low:
            last = [w for w in re.findall(r"[^\W\d_]+", low.split(",")[0].replace("'", "")) if w not in TITLES and w not in LIGHT]
            rest = words[len(last) :]
            if len(last) != 1 or not rest:
                return None
            first, surname = rest[0], last[0]
        else:
            first, surname = words[0], words[-1]
            if len(surname) == 1 and len(first) > 1:
                first, surname = surname, first
            elif surname in self.given and first not in self.given and first not in NICKNAMES and len(first) > 1:
                first, surname = surname, first
        if len(surname) < 2:
            return None
        if len(first) == 1:
            return f"W{_SEP}{first}{_SEP}{surname}", [(first, surname)], ""
        formal = NICKNAMES.get(first, (first,))
        known = [x for x in formal if x in self.given]
        name = "/".join(known or formal)
        # given names one typing error apart have one of their first two letters in common
        return f"P{_SEP}{name}{_SEP}{surname}", [(c, surname) for c in dict.fromkeys("".join(x[:2] for x in name.split("/")))], ""

    def same(self, a: str, b: str) -> bool:
        x, y = a.split(_SEP), b.split(_SEP)
        if x[0] != y[0]:
            if {x[0], y[0]} == {"P", "W"}:
                p, w = (x, y) if x[0] == "P" else (y, x)
                return any(g[0] == w[1] for g in p[1].split("/")) and close(p[2], w[2])
            return False
        if x[0] == "P":
            return close(x[2], y[2]) and any(self._given(g, h) for g in x[1].split("/") for h in y[1].split("/"))
        if x[0] == "G":
            own, other = x[3].split(), y[3].split()
            return x[1:3] == y[1:3] and len(own) == len(other) and self._aligned(own, other)
        return False

    def _given(self, g: str, h: str) -> bool:
        if g == h:
            return True
        if g in self.given and h in self.given:
            return False
        return min(len(g), len(h)) >= 3 and edits(g, h, 1) <= 1

    @staticmethod
    def _aligned(own: list[str], other: list[str]) -> bool:
        """Each word close to one of the other's, one to one."""
        taken: dict[int, int] = {}

        def place(i: int, tried: set[int]) -> bool:
            for j, v in enumerate(other):
                if j not in tried and close(own[i], v):
                    tried.add(j)
                    if j not in taken or place(taken[j], tried):
                        taken[j] = i
                        return True
            return False

        return all(place(i, set()) for i in range(len(own)))


def lexicon(trusted: DataFrame, least: int = 3, share: float = 0.05) -> Forms:
    """Common words and given names: those of trusted names that occur in `share` of the namespaces, and in `least`.

    At most 1 / share times the words of one namespace. Where there are fewer than `least` namespaces, names are spread
    over GROUPS groups by their hash that count instead, so what is collected is small however many names there are."""
    if trusted.agg(F.count_distinct("namespace")).first()[0] < least:
        trusted = trusted.withColumn("namespace", F.pmod(F.xxhash64("name"), F.lit(GROUPS)).cast("string"))
    total = trusted.agg(F.count_distinct("namespace")).first()[0]
    need = max(min(least, total), int(share * total))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for ns, name, kind in zip(*(b[i].to_pylist() for i in range(3)), strict=True):
                if not name:
                    continue
                text = folded(re.sub(r"(?<=[a-z]{3})(?=[A-Z])", " ", name))
                found = [w for w in re.findall(r"[^\W\d_]+", text) if len(w) > 2 and w not in LIGHT and w not in TITLES]
                if kind == "person":
                    behind = [w for w in found if w in text.partition(",")[2]]  # Surname, Given
                    out |= {(ns, w, kind, False) for w in (behind or found)[:1]}
                else:
                    out |= {(ns, SHORT.get(w, w), kind or "", w == found[0]) for w in found if w not in LEGAL}
            if out:
                types = (pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["namespace", "word", "kind", "leads"],
                )

    seen = trusted.select("namespace", "name", F.lower("type")).mapInArrow(
        words, "namespace string, word string, kind string, leads boolean",
    ).withColumn("person", F.col("kind") == "person")
    per = lambda rows, by: rows.groupBy("word", by).agg(F.count_distinct("namespace").alias("n")).where(F.col("n") >= need)
    counted = per(seen, "person").collect()
    given = {r.word: r.n for r in counted if r.person}
    common = {r.word: r.n for r in counted if not r.person}
    leading: dict[str, set[str]] = {}
    for r in per(seen.where("leads"), "kind").collect():
        if r.kind and r.n > given.get(r.word, 0):
            leading.setdefault(r.kind, set()).add(r.word)
    return Forms(
        frozenset(w for w, n in common.items() if n > given.get(w, 0)), frozenset(w for w, n in given.items() if n > common.get(w, 0)), {k: frozenset(ws) for k, ws in leading.items()}
    )


def _parse(forms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [forms.value.parse(s, k) for s, k in zip(b["text"].to_pylist(), b["kind"].to_pylist(), strict=True)]
            keys = [[(f"{g}{_SEP}{e}", w) for g, w in p[1] for e in codes(w)] for p in parsed]
            yield pa.RecordBatch.from_arrays(
                [
                    b["namespace"], b["text"], b["kind"], pa.array([p[0] for p in parsed], pa.string()),
                    *(
                        pa.array([[x[i] for x in xs] for xs in some], pa.list_(pa.string()))
                        for some in (keys, [p[1] for p in parsed]) for i in (0, 1)
                    ),
                    pa.array([p[2] for p in parsed], pa.string()),
                ],
                names=["namespace", "text", "kind", "form", "keys", "words", "groups", "members", "initials"],
            )

    return run


def _compare(forms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = forms.value.same
            keep = pa.array([same(x, y) for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)], pa.bool_())
            yield b.filter(keep)

    return run


def _sure_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, e) for i, w in enumerate(b["word"].to_pylist()) for e in sure_codes(w)]
        rows = b.take(pa.array([i for i, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([e for _, e in found], pa.string())], names=["namespace", "group", "word", "key"])


def _sure_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = zip(b["wa"].to_pylist(), b["wb"].to_pylist(), strict=True)
        yield b.filter(pa.array([jaro_winkler(x, y) >= SURE or jaro_winkler(y, x) >= SURE for x, y in both], pa.bool_()))


def _surely(forms: DataFrame) -> DataFrame:
    """namespace, a, b: forms with different words of one group that have a similarity of SURE."""
    held = written(
        forms.select("namespace", "form", F.explode(F.arrays_zip("groups", "members")).alias("g")).select(
            "namespace", "form", F.col("g.groups").alias("group"), F.col("g.members").alias("word"),
        ),
        "held",
    )
    keyed = written(
        held.select("namespace", "group", "word").distinct().mapInArrow(_sure_keys, "namespace string, group string, word string, key string"), "sure",
    )
    left, right = (keyed.select("namespace", "group", "key", F.col("word").alias(f"w{x}")) for x in "ab")
    # the longer word's letters without a partner are no more than its share of those of both words
    near = F.length("wa") + F.length("wb") >= F.greatest(F.length("wa"), F.length("wb")) * 1.64
    met = left.join(right, ["namespace", "group", "key"]).where("wa < wb").where(near).select("namespace", "group", "wa", "wb").distinct()
    words = written(met.mapInArrow(_sure_pairs, "namespace string, group string, wa string, wb string"), "similar")
    for x in "ab":
        words = words.join(held.select("namespace", "group", F.col("form").alias(x), F.col("word").alias(f"w{x}")), ["namespace", "group", f"w{x}"])
    return words.where("a != b").select("namespace", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _meeting(parsed: DataFrame) -> DataFrame:
    """namespace, a, b: forms that share a block and whose words there are not too far apart, or are similar for sure."""
    # keys and groups follow from the form
    forms = parsed.select("namespace", "form", "keys", "words", "groups", "members").dropDuplicates(["namespace", "form"])
    blocks = forms.select("namespace", "form", F.explode(F.arrays_zip("keys", "words")).alias("k"))
    blocks = written(blocks.select("namespace", "form", F.col("k.keys").alias("key"), F.col("k.words").alias("word")), "blocks")
    crowded = blocks.groupBy("namespace", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("namespace", "key")
    w = F.col("word")
    without = lambda x: F.transform(
        F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)),
    )
    one = F.when(w == "", F.array(w)).otherwise(F.concat(F.array(w), without(w)))
    some = F.when(
        F.length(w) >= LONG_WORD, F.array_distinct(F.concat(one, F.flatten(F.transform(without(w), without)))),
    ).otherwise(F.array_distinct(one))
    finer = blocks.join(crowded, ["namespace", "key"], "left_semi").select("namespace", "form", "key", "word", F.explode(some).alias("part"))
    finer = finer.withColumn("key", F.concat_ws(_SEP, "key", "part")).drop("part")
    placed = blocks.join(crowded, ["namespace", "key"], "left_anti").unionByName(finer)
    left, right = (placed.select("namespace", "key", F.col("form").alias(x), F.col("word").alias(f"w{x}")) for x in "ab")
    most = F.when(F.least(F.length("wa"), F.length("wb")) >= LONG_WORD, 4).otherwise(2)  # a swap counts as two
    far = F.levenshtein("wa", "wb", 4)
    return left.join(right, ["namespace", "key"]).where("a < b").where(far.between(0, most)).select("namespace", "a", "b").unionByName(_surely(forms)).distinct()


def link_names(rows: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """id, namespace, thing: ids of one namespace with one thing stand for the same.

    rows: id, namespace, name, aliases, type, city (may be null). trusted: rows of reliable type to learn common words from."""
    spark = rows.sparkSession
    forms = spark.sparkContext.broadcast(lexicon(trusted if trusted is not None else rows))
    rows = rows.select(
        "id", F.coalesce("namespace", F.lit("")).alias("namespace"), "name", "aliases", F.lower("type").alias("kind"),
        "city",
    ).where(F.col("id").isNotNull()).dropDuplicates(["id"])
    texts = rows.select(
        "id", "namespace", "kind", "city",
        F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "text"),
    ).where(F.trim("text") != "")
    parsed = written(
        texts.select("namespace", "text", "kind").distinct().mapInArrow(
            _parse(forms),
            "namespace string, text string, kind string, form string, keys array<string>, words array<string>, groups array<string>, members array<string>, initials string",
        ),
        "parsed",
    ).where("form != ''")
    said = written(
        texts.join(
            parsed.select("namespace", "text", F.col("kind").alias("k2"), "form", "initials"), ["namespace", "text"],
        ).where(F.col("kind").eqNullSafe(F.col("k2"))).drop("k2"),
        "said",
    )
    strong = F.col("form").substr(1, 1).isin("P", "G")
    alike = written(_meeting(parsed).mapInArrow(_compare(forms), "namespace string, a string, b string"), "alike")
    node = lambda c: F.concat_ws(_SEP, "namespace", c)
    first = said.where(strong).groupBy("id").agg(F.min_by("form", "n").alias("a"))
    by_alias = said.where(strong).join(first, "id").where(F.col("form") != F.col("a")).select(node("a").alias("a"), node("form").alias("b"))
    firm = alike.where(~F.col("a").startswith("W") & ~F.col("b").startswith("W")).select(node("a").alias("a"), node("b").alias("b"))
    found = components(firm.unionByName(by_alias), "a", "b", "names")
    forms_of = written(
        said.where(strong).select("namespace", "form", "initials").distinct().withColumn("node", node("form")).join(found, "node", "left").select("namespace", "form", "initials", F.coalesce("component", "node").alias("thing")),
        "things",
    )
    things = forms_of.select("namespace", "form", "thing").distinct()

    placed = first.join(rows.select("id", "namespace", "city"), "id").join(things.withColumnRenamed("form", "a"), ["namespace", "a"]).select("id", "namespace", "city", "thing")
    placed = written(placed, "placed")
    weak = said.where(~strong).join(placed.select("id"), "id", "left_anti").where("n = 0").select("id", "namespace", "city", "form")
    claimed = said.where(~strong).join(placed.select("id", "thing"), "id").select("namespace", F.col("form").alias("weak"), "thing").distinct()
    short = alike.where(F.col("a").startswith("P") & F.col("b").startswith("W")).select(
        "namespace", F.col("a").alias("form"), F.col("b").alias("weak"),
    ).join(things, ["namespace", "form"])
    acronyms = forms_of.where("initials != ''").select("namespace", F.concat(F.lit(f"I{_SEP}"), "initials").alias("weak"), "thing")
    fits = written(
        claimed.select("*", F.lit(1).alias("claims")).unionByName(short.select("namespace", "weak", "thing", F.lit(0).alias("claims"))).unionByName(acronyms.select("*", F.lit(0).alias("claims"))).groupBy("namespace", "weak", "thing").agg(F.max("claims").alias("claims")),
        "fits",
    )
    per = Window.partitionBy("namespace", "weak")
    fits = fits.withColumn("n", F.count("*").over(per)).withColumn("n_claims", F.sum("claims").over(per))
    sole = fits.where("n = 1 OR (n_claims = 1 AND claims = 1)").select("namespace", F.col("weak").alias("form"), "thing")
    open_ = fits.where("n > 1 AND n_claims != 1").select("namespace", F.col("weak").alias("form"), "thing")
    cities = placed.where("city IS NOT NULL").select("thing", "city").distinct()
    local = weak.where("city IS NOT NULL").join(open_, ["namespace", "form"]).join(cities, ["thing", "city"]).groupBy("id").agg(F.count("*").alias("n"), F.min("thing").alias("by_city")).where("n = 1").select("id", "by_city")
    joined = weak.join(sole, ["namespace", "form"], "left").join(local, "id", "left").select(
        "id", "namespace", F.coalesce("thing", "by_city", node("form")).alias("thing"),
    )
    done = placed.select("id", "namespace", "thing").unionByName(joined)
    rest = rows.join(done.select("id"), "id", "left_anti").select("id", "namespace", F.concat_ws(_SEP, F.lit("id"), "id").alias("thing"))
    return done.unionByName(rest)


def pairs(linked: DataFrame) -> DataFrame:
    """id_a, id_b of all rows of one thing. The list of pairs is what is asked for, so it grows with things' sizes."""
    linked = written(linked, "linked")
    a, b = linked.select("namespace", "thing", F.col("id").alias("id_a")), linked.select("namespace", "thing", F.col("id").alias("id_b"))
    return a.join(b, ["namespace", "thing"]).where("id_a < id_b").select("id_a", "id_b")
