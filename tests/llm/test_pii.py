"""Base spans against Python's re, and the label model."""

import hashlib
import random
import re

from procatlas.llm import pii

DIGITS = lambda v: re.sub("[^0-9]", "", v)


def luhn(v):
    total = 0
    for k, c in enumerate(reversed(v)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(DIGITS(v)) <= 19 and luhn(DIGITS(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(DIGITS(v)) <= 15)]


def base(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(documents, rows):
    got = pii.find_spans(documents(rows)).drop("found").collect()
    want = [(d, *(sum(s[0] == k for s in base(t)) for k, _, _ in BASE), hashlib.sha256(shown(base(t)).encode()).hexdigest()) for d, t in rows]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        mine = r.spans.split(",") if r.spans else []
        assert any(set(shown(base(t)).split(",")) - {""} <= set(mine) for d, t in rows if d == r.doc_id)
        kinds = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in mine]
        assert kinds == sorted(kinds)
    return {r.doc_id: r.spans for r in got}


def test_random_texts(documents):
    rng = random.Random(5)
    bits = ["a@b.c", "x_y", "@", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.08.9.1", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "  ",
            "-", "--", "+1 (988) 555-2485", "+", "12", "5", "é", "😀", "a.b+c@d-e.f.g", "4041894974608795", "00000000000000000000", "(", ")", "\n", "555-123-4567", "@d.e"]
    check(documents, [(k, "".join(rng.choices(bits, k=rng.randint(1, 14)))) for k in range(400)])


def test_long_runs_and_edges(documents):
    """The loops of the comparison are quadratic in such runs, so these are shorter than the next test's."""
    rows = [(1, None), (2, ""), (3, "a" * 1500), (4, "1 2 3 4 5 6 7 8 9 " * 60), (5, "1" * 1500), (6, "1." * 500), (7, "a.b@c.d " * 200),
            (7, "mail a@b.cc"), (7, "mail a@b.cc"), (None, "call +44 20 7946 0958"), (8, "@" * 1500), (9, "- " * 800 + "4111111111111111")]
    check(documents, rows)


def test_very_long_texts(documents):
    rows = [(1, "a" * 200_000), (2, "1 2 3 4 5 6 7 8 9 " * 6000), (3, "1" * 100_000), (4, "x 1.2.3.4 " * 1500), (5, "@" * 50_000), (6, "- " * 40_000 + "4111111111111111"),
            (7, "w " * 100_000 + "a@b.cc"), (8, "9 - " * 30_000)]
    got = {r.doc_id: r.spans for r in pii.find_spans(documents(rows)).collect()}
    assert [got[k] for k in (1, 2, 3, 5, 8)] == [""] * 5
    assert got[4].count("ip:") == 1500 and got[4].startswith("ip:2:9,ip:12:19,")
    assert got[6] == "card:80000:80016" and got[7] == "email:200000:200006"


def test_empty_table(documents):
    assert pii.find_spans(documents([])).collect() == []
    assert pii.redact(documents([])).collect() == []


def test_looser_spans_by_context(documents):
    """A national number after 'call' is taken, one after 'part' is not; base spans stay either way."""
    rows = [(k, f"call +1 (988) 555-{2000 + k} or phone me: 988-555-{1000 + k} now") for k in range(40)]
    rows += [(100 + k, f"see section part 988-555-{1000 + k}7 of version") for k in range(40)]
    rows += [(200 + k, f"mail joe{k} (at) site (dot) com please") for k in range(40)]
    got = check(documents, rows)
    assert all(got[k].count("phone:") == 2 for k in range(40))
    assert all("phone" not in got[100 + k] for k in range(40))
    assert all(got[200 + k].startswith("email:") for k in range(40))


def test_redaction(documents):
    text = "é write to a@b.cc or +1 (988) 555-2485, 10.0.0.1 end"
    docs = documents([(1, text), (2, None), (3, "clean")])
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "é write to <email> or <phone>, <ip> end" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean" and pii.redact(docs).columns == docs.columns


def test_no_python_in_the_plan(spark, documents):
    plan = pii.find_spans(documents([(1, "a@b.cc")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
