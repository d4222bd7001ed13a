import re
from collections import Counter
from hashlib import md5

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tickspark.llm import pii, queries

from .test_pii import plain_spans, plain_terms
from .test_simhash_dedup import plain_components, plain_fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mix(docs):
    """doc_id -> copies, from (doc_id, source, text)."""
    size = {i: len(WORD.findall(t)) for i, _, t in docs}
    per = Counter()
    for i, s, _ in docs:
        per[s] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per))}
    target, free, rest = {}, set(per), 1.5 * sum(per.values())
    while free:  # share, stop, share the excess again
        level = rest / sum(weight[s] for s in free)
        stop = {s for s in free if level * weight[s] > 2 * per[s]}
        if not stop:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * per[s] for s in stop}
        rest -= sum(2 * per[s] for s in stop)
        free -= stop
    out = {}
    for s in per:
        at, words = 0, round(target[s])
        for i in sorted((i for i, x, _ in docs if x == s), key=lambda i: (md5(f"0:{i}".encode()).hexdigest(), i)):
            taken = sum(max(0, min(words, e * per[s] + at + size[i]) - e * per[s] - at) for e in (0, 1))
            out[i] = int(taken / size[i] + 0.5) if size[i] else 0
            at += size[i]
    return out


def test_stages_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in queries.op9_quality_rules(spark, sf_dir).collect() if r.kept}
    comps = plain_components({i: plain_fingerprint(docs[i].text) for i in kept})
    kept = {i for i in kept if comps[i] == i}
    terms = plain_terms([docs[i].text for i in sorted(kept)])
    texts = {}
    for i in kept:
        text = docs[i].text
        base = plain_spans(text)
        found = [(*m.span(), terms[m[0].lower()]) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in terms and not any(m.start() < b and a < m.end() for _, a, b in base)]
        texts[i] = pii.sanitise_text(text, found)
    copies = plain_mix([(i, docs[i].source, texts[i]) for i in kept])
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i in kept:
        if copies[i]:
            want[i, docs[i].lang, docs[i].source, texts[i], len(texts[i]), tuple(lib.encode(texts[i]))] += copies[i]
    got = Counter((r.doc_id, r.lang, r.source, r.text, r.n_chars, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_odd_rows(spark):
    ordinary = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, ordinary, "en", "a", 5, "x"), (1, ordinary, "en", "a", 5, "x"), (None, ordinary + " more", None, None, None, "y"), (2, None, "en", "a", 0, "z"), (3, "", None, "a", 0, "z"), (4, ordinary.upper() + " tail" * 3, "en", "b", 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        assert out.count() >= 1, name
        if name != "SentencePiece":
            assert out.columns == df.columns
        if name == "SimHash near-dedup":
            assert len([r for r in out.collect() if r.doc_id == 1]) == 1
        assert stage(spark, df.where("false"), "").count() == 0
