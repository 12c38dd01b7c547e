"""Secrets: patterns propose candidates, a random forest trained from labelled findings removes false positives.

Features: length, transitions between classes of characters and between letters, coverage by dictionary words, the document's path, and the
words before and after the candidate. How usual one letter after another is comes from the documents' own words (letter_steps()): a table of 26 x 26
numbers. Other work on the documents is local to a row: no shuffle.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import plain_texts, slices

#: Names of secrets; other parts of a name may stand before them (also as in dbPassword), or after them up to the next such part.
_NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|account[_-]?key|private[_-]?key|credential|auth)s?(?![A-Za-z0-9])"
#: What proposes a candidate: (kind, pattern); the group `s`, or else the whole match, is the candidate. Each search is linear in the text.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "url_password": r"://[^\s/:@\"'<>]*+:(?P<s>[^\s/@\"'<>]{3,}+)@",
    "jwt": r"(?<![A-Za-z0-9_.-])(?P<s>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+)",
    "assigned": rf"(?i)(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z]))){_NAMES}(?:[_-](?!{_NAMES})[A-Za-z0-9]++)*+[\"']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}[\"']?(?P<s>[^\s\"'<>,;]{{8,}})",
    "token": r"(?<![A-Za-z0-9+/_@-])(?P<s>[A-Za-z0-9+/_-]{16,}+={0,2}+)(?![A-Za-z0-9+/_=@-])",
}
REACH = 48
THRESHOLD = 0.5
TREES, DEPTH, SEED = 40, 8, 17
#: Labelled findings that the forest is fitted on: of more than that, a hash draws about so many.
MAX_TRAIN = 100_000

# Words of the neighbourhood and of paths, and a small dictionary.
GOOD_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "credentials", "authorization", "login")
BAD_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "integrity", "uuid", "guid", "revision", "etag", "id", "isbn", "fingerprint", "example", "sample", "placeholder", "dummy", "build")
BAD_PATHS = ("test", "tests", "example", "examples", "docs", "doc", "lock", "vendor", "fixtures", "sample")
GOOD_PATHS = ("env", "config", "conf", "cfg", "ini", "yml", "yaml", "properties", "tf", "sh", "deploy", "settings")
DICTIONARY = (
    "able about account action after again always application array authentication background between browser build button cache change character check class client code column "
    "command comment common component config connection content context control country create current data date default description development device directory document domain "
    "element email empty encoding error event example exception execute export field file filter folder format function general group handle header height hello history home image import "
    "index information input instance integer internal international item language length library license list local location manager memory message method model module name network number "
    "object option order other output package page parameter parent password path pattern person picture place please plugin point position process product profile program project property public query "
    "random reference release remove report request resource response result return root sample schema script search section security select sequence server service session setting simple size source "
    "standard start state statement static status stream string style support system table template text theme thing this time title token transaction type under union update upload user value variable version view visible "
    "warning website where which width window with without work world write your"
).split()
_WORDS = frozenset(w for w in DICTIONARY if len(w) >= 4)
_LONGEST = max(map(len, _WORDS))
_CLASS = {**{c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 2 for c in "0123456789"}}
FEATURES = (
    "log_length entropy lower upper digit other lower_upper letter_digit digit_letter vowel_turns usual_steps least_usual repeats hex dictionary distinct good_before bad_before good_after bad_after assigned quoted path_good path_bad private pattern"
).split()


#: Letters as 0 to 25, small ones, and 32 to 57, capitals; any other byte as 63.
_LETTER = np.full(256, 63, np.uint8)
_LETTER[ord("a") : ord("z") + 1], _LETTER[ord("A") : ord("Z") + 1] = np.arange(26), np.arange(32, 58)
#: Usual steps are averaged over windows of so many letters to find the least usual part.
WINDOW = 8


def _letter_pairs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """26 x first + second of neighbouring letters of texts that end before the places `ends`. A capital begins anew: after a small letter it makes no pair."""
    x = _LETTER[data]
    first, second = x[:-1], x[1:]
    good = (first < 63) & (second < 63) & ~((first < 32) & (second >= 32))
    cuts = ends - 1
    good[cuts[(cuts >= 0) & (cuts < len(good))]] = False
    return (first[good] & 31).astype(np.int64) * 26 + (second[good] & 31)


def _likely(*counts: np.ndarray) -> np.ndarray:
    """26 x 26 logarithms: how much likelier one letter is after another than by chance, each table of counts having an equal say."""
    shares = [(c.reshape(26, 26) + 0.5) / (c.reshape(26, 26) + 0.5).sum(axis=1, keepdims=True) for c in counts]
    return np.log(np.mean(shares, axis=0) * 26)


_COUNTS = np.bincount(np.concatenate([_letter_pairs(np.frombuffer(w.encode(), np.uint8), np.zeros(0, np.int64)) for w in DICTIONARY]), minlength=676)
DICTIONARY_STEPS = _likely(_COUNTS)


def letter_steps(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """26 x 26: how usual a letter is after another one, by the words of all whole texts and by the dictionary, half each.

    Null and empty texts, and letters beyond ASCII, add nothing; without any text the dictionary decides alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(676, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            texts = plain_texts(batch.column(0))
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            if ends[-1] > ends[0]:
                total += np.bincount(_letter_pairs(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[1:-1] - ends[0]), minlength=676)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["step", "n"])

    # at most 676 rows a task before the exchange, and 676 for the driver
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(676)
    counts[[r.step for r in rows]] = [r.n for r in rows]
    return _likely(counts, _COUNTS) if rows else DICTIONARY_STEPS


def usual_steps(candidate: str, likely: np.ndarray) -> tuple[float, float]:
    """(the mean of `likely` over the candidate's neighbouring letters, the mean of its least usual window); 0 without such letters."""
    steps = likely.ravel()[_letter_pairs(np.frombuffer(candidate.encode("utf-8", "replace"), np.uint8), np.zeros(0, np.int64))]
    if not len(steps):
        return 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(steps)])
    k = min(WINDOW, len(steps))
    return float(steps.mean()), float((sums[k:] - sums[:-k]).min() / k)


def dictionary_coverage(candidate: str) -> float:
    """The share of characters inside dictionary words, the longest word first at each place."""
    x, i, covered = candidate.lower(), 0, 0
    while i < len(x):
        n = next((n for n in range(min(_LONGEST, len(x) - i), 3, -1) if x[i : i + n] in _WORDS), 0)
        covered += n
        i += n or 1
    return covered / max(len(x), 1)


def _parts(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.lower()))


def features(kind: str, candidate: str, before: str, after: str, path: str, likely: np.ndarray | None = None) -> list[float]:
    """The numbers named in FEATURES; likely: letter_steps(), or the dictionary's."""
    n = max(len(candidate), 1)
    counts = Counter(candidate)
    classes = [_CLASS.get(c, 3) for c in candidate]
    turns = Counter(zip(classes, classes[1:]))
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    vowels = [c in "aeiouAEIOU" for c in candidate if c.isalpha()]
    near, far, names = _parts(before), _parts(after), _parts(path)
    any_of = lambda words, found: float(bool(found.intersection(words)))
    return [
        math.log1p(n), entropy, *(classes.count(k) / n for k in range(4)), (turns[0, 1] + turns[1, 0]) / n, (turns[0, 2] + turns[1, 2]) / n, (turns[2, 0] + turns[2, 1]) / n,
        sum(a != b for a, b in zip(vowels, vowels[1:])) / max(len(vowels) - 1, 1), *usual_steps(candidate, DICTIONARY_STEPS if likely is None else likely), sum(a == b for a, b in zip(candidate, candidate[1:])) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate))), dictionary_coverage(candidate), len(counts) / n, any_of(GOOD_WORDS, near), any_of(BAD_WORDS, near), any_of(GOOD_WORDS, far), any_of(BAD_WORDS, far),
        float(bool(re.search(r"(?:=>|:=|=|:)[ \t]{0,4}[\"']?$", before))), float(before[-1:] in ("'", '"') and before != ""), any_of(GOOD_PATHS, names), any_of(BAD_PATHS, names), float(kind == "private_key"), float(kind == "assigned"),
    ]


_PATTERNS = {k: re.compile(p) for k, p in PATTERNS.items()}


def propose(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates, in code points; of two with a common part the kind listed first stays. A `token` has a digit and a letter."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS.items():
        known = sorted(taken)
        at = 0
        for m in pattern.finditer(text):
            a, b = m.span("s") if "s" in pattern.groupindex else m.span()
            if kind == "token" and not (re.search("[0-9]", m["s"]) and re.search("[A-Za-z]", m["s"])):
                continue
            while at < len(known) and known[at][1] <= a:
                at += 1
            if at == len(known) or known[at][0] >= b:
                taken.append((a, b, kind))
    return sorted(taken)


def labelled_findings(n: int = 6000, seed: int = SEED) -> list[tuple[str, str, str, str, str, int]]:
    """(kind, candidate, before, after, path, label): made findings of the usual sorts, half of them secrets. Own labelled ones can take their place."""
    rng = random.Random(seed)
    hexa, letters, symbols = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    words = lambda k: " ".join(rng.choice(DICTIONARY) if rng.random() < 0.4 else draw(letters, rng.randint(2, 9)) for _ in range(k))
    paths = ["src", "src1/config.yml", "deploy/.env", "app/settings.py", "docs/readme.md", "tests/fixtures/a.json", "package-lock.json", "web/page", "src7", "vendor/lib.go", "main.tf"]
    out = []
    for i in range(n):
        secret = i % 2 == 0
        noise = lambda: rng.choice(["", "", "", "!! ", "### ", "| "])
        before, after, path = words(rng.randint(1, 6)) + noise(), " " + words(rng.randint(1, 6)), rng.choice(paths)
        kind = "token"
        if secret:
            value = rng.choice([lambda: draw(hexa, rng.choice([32, 40, 64])), lambda: draw(symbols, rng.randint(20, 48)), lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "AKIA"]) + draw(symbols, rng.randint(16, 36)), lambda: draw(symbols + "+/", rng.randint(24, 64)) + "=", lambda: draw(symbols + "!$%", rng.randint(9, 16))])()
            value = value.upper() if rng.random() < 0.1 else value
            if rng.random() < 0.85 or len(value) < 17:
                kind, name = "assigned", rng.choice(["token", "secret", "password", "api_key", "access_key", "auth", "TOKEN"])
                quote = rng.choice(['"', "'", '"', ""])
                before, after = f"{before} {name}{rng.choice([' = ', '=', ': ', ' := '])}{quote}", quote + after
            else:
                before += " " + rng.choice(["bearer ", "key ", "login ", "authorization: "])
        else:
            sort = rng.randrange(7)
            value = [lambda: draw(hexa, 40), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: rng.choice(["", "/"]) + "/".join(rng.choice(DICTIONARY) for _ in range(3)) + str(rng.randint(0, 99)),
                     lambda: "_".join(rng.choice(DICTIONARY) for _ in range(3)) + str(rng.randint(1, 9)), lambda: draw(hexa, rng.choice([32, 64])), lambda: "a1" * rng.randint(8, 30), lambda: draw(letters, rng.randint(15, 30)) + str(rng.randint(0, 2030))][sort]()
            if sort in (0, 4):
                before += " " + rng.choice(["commit ", "sha256:", "md5 = ", "checksum: ", "digest=", "etag: ", "revision "])
            elif sort == 1:
                before += " " + rng.choice(["uuid ", "id: ", "guid=", ""])
            elif rng.random() < 0.35:
                kind, name = "assigned", rng.choice(["token", "password", "secret", "key"])
                value = rng.choice(["${%s}" % rng.choice(DICTIONARY).upper(), "your_%s_here" % name, "xxxxxxxxxxxx", "process.env.%s" % name.upper(), "changeme_example", rng.choice(DICTIONARY) + rng.choice(DICTIONARY)])
                before = f"{before} {name}{rng.choice([' = ', ': ', '='])}"
            else:
                before += " "
        out.append((kind, value, before[-REACH:], after[:REACH], path, int(secret)))
    # digests in base 64 and names in camel case, and secrets of the same letters
    for i in range(n // 3):
        secret, sort = i % 2 == 0, i // 2 % 2
        before, after, path, kind = words(rng.randint(0, 4)) + " ", " " + words(rng.randint(1, 6)), rng.choice(paths), "token"
        quote = rng.choice(['"', "'", ""])
        if sort == 0:
            value = draw(symbols + "+/", rng.choice([22, 27, 32, 43, 64, 86])) + rng.choice(["", "=", "=="])
            if secret:
                kind, before, after = "assigned", before + rng.choice(["token", "secret", "password", "api_key", "auth"]) + rng.choice([" = ", "=", ": "]) + quote, quote + after
            else:
                value = rng.choice(["", "sha256-", "sha384-", "sha512-", "sha1-"]) + value
                before += rng.choice(["integrity", "digest", "checksum", "hash", "fingerprint", "etag"]) + rng.choice([" ", ": ", "=", '": ']) + quote
        elif secret:
            value = draw(symbols, rng.randint(17, 40))
            before += rng.choice(["bearer ", "key ", "login ", "authorization: ", "token "])
        else:
            value = "".join(rng.choice(DICTIONARY).title() for _ in range(rng.randint(2, 5))) + rng.choice(["", "V", "Test"]) + str(rng.randint(0, 99)) + rng.choice(["", "Test", "Impl"])
            value = value if rng.random() < 0.6 else value[0].lower() + value[1:]
            before += rng.choice(["", "class ", "method ", "in ", "call "])
        out.append((kind, value, before[-REACH:], after[:REACH], path, int(secret)))
    # names with other parts, URL user-info and dotted tokens, each with false ones
    for i in range(n // 3):
        secret, sort = i % 2 == 0, i // 2 % 3
        before, after, path = words(rng.randint(0, 4)) + " ", " " + words(rng.randint(1, 6)), rng.choice(paths)
        value = draw(symbols, rng.randint(9, 40)) if secret else rng.choice(["${%s}" % rng.choice(DICTIONARY).upper(), "your_%s_here" % rng.choice(DICTIONARY), "xxxxxxxxxxxx", "changeme_example", rng.choice(DICTIONARY) + rng.choice(DICTIONARY)])
        if sort == 0:
            kind, word = "assigned", rng.choice(["%s_password", "%s_SECRET_ACCESS_KEY", "client_secret_%s", "%s_token", "%s-api-key"])
            if secret and rng.random() < 0.4:
                value = rng.choice(DICTIONARY) + draw("0123456789", rng.randint(1, 5)) + rng.choice([draw(letters, rng.randint(3, 6)), rng.choice(DICTIONARY)])
            before += word % rng.choice(DICTIONARY) + rng.choice(["=", ": ", " = "])
        elif sort == 1:
            kind, before, after = "url_password", before + rng.choice(["postgres", "https", "amqp", "mysql"]) + "://" + rng.choice(DICTIONARY) + ":", "@" + rng.choice(DICTIONARY) + after
        else:
            kind, before = "jwt" if secret else "token", before + rng.choice(["Bearer ", "session=", ""])
            value = "eyJ" + ".".join(draw(symbols + "-_", rng.randint(16, 60)) for _ in range(3)) if secret else "_".join(rng.choice(DICTIONARY) for _ in range(3)) + str(rng.randint(1, 9))
        out.append((kind, value, before[-REACH:], after[:REACH], path, int(secret)))
    return out


def train(spark: SparkSession, findings: DataFrame | None = None, max_train: int = MAX_TRAIN, likely: np.ndarray | None = None) -> RandomForestClassificationModel:
    """The forest, from findings of (kind, candidate, before, after, path, label); None: made ones. Rows with a null are left out. likely: as in scan()."""
    if findings is None:
        made = [(features(*x[:5], likely), float(x[5])) for x in labelled_findings()]
        rows = spark.createDataFrame(made, "x array<double>, label double")
    else:
        findings = findings.select("kind", "candidate", "before", "after", "path", F.col("label").cast("double").alias("label")).dropna()
        n = findings.count()
        if n > max_train:
            findings = findings.filter(F.pmod(F.xxhash64(F.lit(SEED), "kind", "candidate", "before"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [features(*row, likely) for row in zip(*(batch.column(i).to_pylist() for i in range(5)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(5)], ["x", "label"])

        rows = findings.mapInArrow(run, "x array<double>, label double")
    # one partition, of bounded size: the forest doesn't depend on how rows are dealt
    rows = rows.select(array_to_vector("x").alias("features"), "label").coalesce(1)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD, likely: np.ndarray | None = None) -> DataFrame:
    """(doc_id, start, end, kind, candidate, score, kept) of every candidate in every whole text; positions in code points, end exclusive.

    kept: the forest gives it a probability of at least the threshold; the others are the removed false positives. likely: letter_steps() of the
    documents, the same that train() was given; None: the dictionary's.

    * Null and empty texts have no candidates. A null path, or path_col = None, is the empty path.
    * Repeated rows and null ids are each scanned. Other columns are ignored. An empty table gives an empty result.
    """
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            ids, starts, ends, kinds, found, xs = [], [], [], [], [], []
            for doc_id, text, where in zip(batch.column(0).to_pylist(), plain_texts(batch.column(1)).to_pylist(), batch.column(2).to_pylist()):
                for a, b, kind in propose(text):
                    ids.append(doc_id), starts.append(a), ends.append(b), kinds.append(kind), found.append(text[a:b])
                    xs.append(features(kind, text[a:b], text[max(0, a - REACH) : a], text[b : b + REACH], where, likely))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string()), pa.array(found, pa.string()), pa.array(xs, pa.list_(pa.float64()))],
                    ["doc_id", "start", "end", "kind", "candidate", "x"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), path.alias("path"))
    rows = rows.mapInArrow(run, "doc_id bigint, start bigint, end bigint, kind string, candidate string, x array<double>")
    scored = model.transform(rows.withColumn("features", array_to_vector("x")))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "start", "end", "kind", "candidate", score.alias("score"), (score >= threshold).alias("kept"))
