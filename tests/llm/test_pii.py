"""The base kinds against a plain scan by the contract's own patterns."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hostlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def plain(text):
    spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [s for *_, s in sorted(spans)]


def base(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    rows = pii.find_pii(df).select("doc_id", pii.spans_text(F.filter("pii", lambda s: s.kind.isin(*pii.BASE))).alias("s")).collect()
    return {r.doc_id: [x for x in r.s.split(",") if x] for r in rows}


PIECES = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "256.1.1.1", "001.02.3.4.5", "a.b+c@d-e.org", "x@y", "@@a@b.c", "+49 (30) 123-4567", "+1", "+12345678901234567", " ", "-", ".", "9", "eé\U0001f600", "\n", "+4", "@a.b"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(alphabet="0123456789 .-+@a()", max_size=8)), max_size=8).map("".join), min_size=20, max_size=40))
def test_base_spans(spark, texts):
    got = base(spark, texts)
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_added_kinds_context_and_redaction(spark):
    texts = ["IBAN DE89370400440532013000 ok", "DE89370400440532013001", "my ssn 123-45-6789", "part 123-45-6789", "call (555) 123-4567 now", "555-123-4567", None, ""]
    texts += ["DE89370400440532013000 BIC COBADEFFXXX", "pay GB82 WEST 1234 5698 7654 32 AND MORE", "DE8937040044053201300 X"]
    out = pii.find_pii(spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, _email string"))
    assert out.filter("_email = 'k'").count() == len(texts)
    got = {r.doc_id: [s.kind for s in r.pii] for r in out.collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["local_phone"], 5: [], 6: [], 7: [], 8: ["iban"], 9: ["iban"], 10: []}
    assert {r.doc_id: r.text for r in pii.redact(out).collect()}[2] == "my ssn [SSN]"


def test_long_text_and_empty_table(spark):
    long = "a" * 300_000 + " x@y.org " + "1." * 100_000
    assert base(spark, [long]) == {0: plain(long)}
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_matches_and_long_gaps(spark):
    """Long texts, with characters outside the BMP, by the contract's own patterns; positions on chunk borders."""
    rng = random.Random(3)
    many = " ".join(f"u{i}@host{i % 7}.org {i % 300}.0.0.{i % 256} +49 30 {1000000 + i}" for i in range(3_000))
    spaced = "".join(rng.choice(["\U0001f600", "\u00e9", "w ", "\n"]) * rng.randint(1, 700) + rng.choice(PIECES) for _ in range(200))
    edge = "".join("x" * ((1 << pii.CHUNK_BITS) - 9 * k) + " a@b.cd " for k in range(40))
    texts = [many, spaced, edge, "a@b.cd" * 600, "a@b.cd " + "\U0001f600" * 5000 + " a@b.cd"]
    got = base(spark, texts)
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def plain_redaction(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
    return "".join([*out, text[at:]])


def test_redaction_of_long_texts(spark):
    texts = ["call (555) 123-4567 \U0001f600 " * 900 + "x@y.org", "10.0.0.1" + "\u00e9" * 5000 + "10.0.0.2", "1@10.0.0.1 +4930123456789@x.yz", "", None, "nothing"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    found = pii.find_pii(df)
    assert found.columns == ["doc_id", "text", "a.b", "pii"]
    clean = {r.doc_id: (r.text, r["a.b"]) for r in pii.redact(found).collect()}
    assert clean == {r.doc_id: (plain_redaction(r.text or "", r.pii), "k") for r in found.collect()}


def test_added_spans_beside_base_ones(spark):
    """An added span stays only where no base span meets it, however many there are."""
    cases = [f"ssn 123-45-6789 a{i}@b.org" if i % 2 else f"call 555-123-4567 +1 {5551234567 + i} ssn 123-45-6789" for i in range(700)]
    text = " ; ".join(cases) + " phone 123-456-7890@x.org"
    rows = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii
    base = [(s.start, s.end) for s in rows if s.kind in pii.BASE]
    added = [(s.start, s.end, s.kind) for s in rows if s.kind not in pii.BASE]
    assert sum(k == "ssn" for *_, k in added) == 700 and all(not any(a < f and b < e for b, f in base) for a, e, _ in added)
    assert [(s.start, s.kind) for s in rows] == sorted(((s.start, s.kind) for s in rows), key=lambda x: (x[0], pii.KINDS.index(x[1])))
