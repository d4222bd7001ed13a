import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickspark.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("text", ["", "a@b.c@d.e", "@a.b", "x@y", "x@y.", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485 x", "+1234567", "++12345678", "me.42@mail8.example.com, 10.0.0.1", " @a.b @c.d", "4111 1111 1111 1111 4111", "+1........"])
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1234567890..@@ -+()é"), max_size=60))
def test_base_spans_of_random_texts(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    n = 300_000
    for text in ("a" * n, "1" * n, "1." * n, " @a.b" * (n // 5), "+1" + " " * n, "+" * n, "1 " * n):
        pii.base_spans(text)


def plain_terms(texts):
    """The method by its definition: nested loops over whole texts."""
    near, ctx, of_e = defaultdict(set), defaultdict(set), defaultdict(set)
    holds = defaultdict(set)
    for d, text in enumerate(texts):
        spans = plain_spans(text)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text)]
        for _, _, w in words:
            holds[w].add(d)
        free = [x for x in words if not any(x[0] < b and a < x[1] for _, a, b in spans)]
        for kind, a, b in spans:
            value = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            around = [w for s, e, w in free if e <= a][-6:] + [w for s, e, w in free if s >= b][:6]
            of_e[kind, value].add(d)
            for w in around:
                if len(w) >= 4:
                    near[kind, value, w].add(d)
                    ctx[kind, value, w].add(tuple(around))
    out = {}
    for (kind, value, w), docs in near.items():
        information = math.log(len(texts) / len(of_e[kind, value]))
        if len(ctx[kind, value, w]) >= 3 and information > 0:
            shown = 1 + math.log(min(1, len(docs) / len(holds[w]))) / information
            if shown >= pii.GENERALISE:
                out[w] = max(out.get(w, 0), shown)
    return out


def corpus():
    texts = [f"filler number{i} words about nothing in particular with common talk" for i in range(60)]
    for i in range(5):  # a nickname that gives an address away, and words that tell nothing
        texts.append(f"start {'abcde'[i] * 5} nickname zorblax wrote from zor.blax@mail.example.com about common talk here")
        texts.append(f"call quendra{'x' * i} or quendrix at +1 (555) 010-9988 for words number{i} more")
    texts += ["so zorblax is named alone", "and Quendrix too, ZORBLAX", "quendrix elsewhere", ""]
    for i in range(4):  # a word that tells of an address, far away in characters
        texts.append(f"{'fghij'[i] * 5} {'gh' * 30} farfarword {' ' * 300} far.away@mail.example.org {'.' * 250} tailword {i}")
    return texts + [texts[60]] * 20


def test_terms_and_spans(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, None, "k")], "doc_id long, text string, spans string")
    want = plain_terms([*texts, ""])
    assert {"zorblax", "quendrix", "farfarword", "tailword"} <= want.keys() and "common" not in want
    got = {r.term: r.disclosure for r in pii.disclosing_terms(df.select("text")).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    for r in pii.find_personal_data(df).collect():
        text = texts[r.doc_id] if r.doc_id is not None else ""
        base = plain_spans(text)
        own = [m.span() for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in want and not any(m.start() < b and a < m.end() for _, a, b in base)]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base + [("term", *x) for x in own])
        plain = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.spans, r.n_term, r.base_sha256) == (told, len(own), hashlib.sha256(plain.encode()).hexdigest())
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(clean) == len(texts) + 1 and clean[None].text is None and clean[0].text == texts[0] and clean[0].spans == "k"
    assert "zorblax" not in clean[60].text.lower() and "[EMAIL]" in clean[60].text and "common talk" in clean[60].text
    assert all(not plain_spans(r.text or "") for r in clean.values())


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        n = [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        plain = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (n, hashlib.sha256(plain.encode()).hexdigest())
        assert r.spans.startswith(plain)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(df).count() == 0 and pii.sanitise(df).count() == 0
