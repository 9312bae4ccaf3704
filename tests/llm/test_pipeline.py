"""The pipeline against a plain, single-process version of its stages."""

import importlib
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from logweir.llm import secrets
from logweir.llm.decontam import Items, normal
from logweir.llm.toxicity import ToxicityClassifier

DIR = "/root/testdata/sf0.001"


def groups(texts):
    """doc_id -> least id of its group: 5-word shingles, a similarity of 0.8, all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp


def test_against_plain_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = ToxicityClassifier().fit(docs, spark.read.parquet(f"{DIR}/labels.parquet")).model
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if model.score(t)[0] < 0.3}
    group = groups(texts)
    texts = {i: t for i, t in texts.items() if group[i] == i}
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    items = Items([b.item_id for b in bench], [normal(b.text) for b in bench], 80, 0.08)
    texts = {i: t for i, t in texts.items() if not items.found(t)}
    texts = {i: secrets.redact(t, secrets.scan(t)) for i, t in texts.items()}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, DIR).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(texts) and 0 < len(texts) < docs.count()
    for i, t in texts.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_planted_cases(spark, tmp_path):
    src = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    clean = " ".join(f"word{i}" for i in range(80))
    near = clean.replace("word40", "changed")
    new = [(10**6, clean), (10**6 + 1, clean), (10**6 + 2, near), (10**6 + 3, "before " + bench + " after"), (10**6 + 4, 'then token = "0123456789abcdef0123456789abcdef01234567" went'), (10**6 + 5, None), (10**6 + 6, "")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in new], "doc_id long, text string, lang string, source string, n_chars long")
    src.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        seen[name] = {r.doc_id: r for r in docs.where(f"doc_id >= {10**6}").collect()}
        if name != "packing":
            assert docs.columns == src.columns
    short = lambda name: sorted(i - 10**6 for i in seen[name])
    assert short("toxicity") == [0, 1, 2, 3, 4, 5, 6] and short("near_dedup") == [0, 3, 4, 5, 6]
    assert short("decontamination") == [0, 4, 5, 6] == short("packing")
    masked = seen["secret_scan"][10**6 + 4]
    assert masked.text == 'then [SECRET]" went' and masked.n_chars == len(masked.text)


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").where("1 = 0").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_documents(spark, tmp_path):
    """Null ids, repeated rows, an id with two texts, a very long text and columns whose names clash with the operators' own."""
    long = " ".join(f"calm{i % 4999} word{i % 613}" for i in range(40_000))
    rows = [(None, "a note without an id", 1), (None, None, 2), (1, "the same row twice over", 3), (1, "the same row twice over", 3), (2, "an id with one text", 4), (2, "and with quite another text here", 5), (3, long, 6), (4, long + " tail", 7)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, "x", 0.5, [k]) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, label string, score double, bands array<int>")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    left = sorted((r.doc_id or 0, r.text or "", r.node) for r in out.collect())
    assert [(i, k) for i, _, k in left] == [(0, 2), (0, 1), (1, 3), (2, 4), (2, 5), (3, 6)] and left[-1][1] == long
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in pieces}) == 4 and sum(r.start == 0 for r in pieces) == 6
    for i in (3,):
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False))


def test_registered():
    e = importlib.import_module("__spark_entry__")
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
