import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from logweir.llm import best_fit, packing
from logweir.llm.token_count import Resync, token_counts
from logweir.llm.tokenize import MARK, SAFE, byte_bpe, byte_chars, load_model, word_bpe

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a", "a" * 5000, " " * 3000 + "x", " \n" * 500, "don't I'LL we've" * 30, "中文 かな" * 40, "İstanbul ΣΑΣ ΐ ñandú é ẞ", "a\x1cb\x85c\xa0d e", "<|endoftext|> a<|startoftext|>b<|endoftext|>", "x<|endof", "1234 ½ ²x", "emoji 🙂🙃 ok", "AbC!? --' <b>"]
SCHEMA = "doc_id long, text string, ids string, node int"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_vocabulary_is_proper(path):
    """Every merged token comes out whole when merged alone by the listed pairs, in rank order."""
    vocab, merges, whole = load_model(path)
    end = whole["model"]["end_of_word_suffix"] or ""
    rank = {m: i for i, m in enumerate(merges)}
    for a, b in merges:
        word = a + b
        tail = bool(end) and word.endswith(end)
        parts = list(word[: -len(end)] if tail else word)
        if tail:
            parts[-1] += end
        while len(parts) > 1:
            i = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))  # noqa: B023
            if (parts[i], parts[i + 1]) not in rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [word]
    assert len({a + b for a, b in merges}) == len(merges)
    assert len(byte_chars()) == 256 and len(MARK) == 1


def test_word_ids_are_the_librarys(texts):
    bpe, lib = word_bpe(WORDS), Tokenizer.from_file(WORDS)
    ids, per, lens, stop = bpe.encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, per.tolist(), strict=True):
        assert ids[at : at + n].tolist() == lib.encode(t, add_special_tokens=False).ids
        at += n
    assert lens.sum() == len(ids) and len(stop) == len(lens)


def test_byte_ids_are_the_librarys(texts):
    bpe, lib = byte_bpe(BYTES), Tokenizer.from_file(BYTES)
    for t in texts:
        parts = bpe.parts(t)
        assert sum(len(bpe.ordinary(p)) for p in parts) + len(parts) - 1 == len(lib.encode(t, add_special_tokens=False).ids)


def test_safe_characters_alone():
    """Each character that takes the fast way is classed as by the library, between others."""
    bpe, lib = byte_bpe(BYTES), Tokenizer.from_file(BYTES)
    for c in map(chr, range(0x2100)):
        if SAFE.fullmatch(c):
            t = f"a{c}b 1{c}2 .{c}, {c}{c}"
            assert bpe.core.encode_ordinary(t) == lib.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_resync_is_the_whole_encoding():
    bpe, rng = byte_bpe(BYTES), random.Random(2)
    sync = Resync(bpe, 120, 16)
    mixed = ["".join(rng.choice(" \n\t'sréaé1!中.") for _ in range(3000)) for _ in range(5)]
    for t in [*ODD, *mixed, "word " * 2000, "ab1!" * 900]:
        for part in bpe.parts(t):
            assert [i for p in sync.pieces(part) for i in p] == bpe.ordinary(part)
    assert sync.widened
    with pytest.raises(ValueError):
        Resync(bpe, 10, 10)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (0, texts[0], "x", 1), (9000, None, None, None)], SCHEMA)


def test_counts(spark, texts):
    lib = Tokenizer.from_file(BYTES)
    got = token_counts(table(spark, [*texts, "long words and more " * 20_000]), BYTES).collect()
    by = {r.doc_id: r for r in got}
    for i, t in enumerate([*texts, "long words and more " * 20_000]):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len(t.encode()), n, n > 1024)
    assert by[9000].n_tokens == 0 and by[None].n_tokens == 2 and len(got) == len(texts) + 4
    assert token_counts(spark.createDataFrame([], SCHEMA), BYTES).collect() == []


def test_pack_is_lossless(spark, texts):
    lib = Tokenizer.from_file(WORDS)
    some = [*texts, " ".join(["packing"] * 30_000), "z" * 30_000]
    d = table(spark, some).coalesce(1)
    rows = packing.pack(d, WORDS).collect()
    assert len(packing.pieces(packing.pack(d, WORDS)).collect()) == len(rows)
    per, seqs = {}, {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    for i, t in enumerate(some):
        want = [*lib.encode(t, add_special_tokens=False).ids, 1]
        got = sorted(per[i], key=lambda r: r.start)
        if i:  # 0 is there twice
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want
            assert [r.start for r in got] == np.cumsum([0, *[r.length for r in got]])[:-1].tolist()
        assert all(r.doc_tokens == len(want) for r in got)
    assert len(per[9000]) == 1 and per[9000][0].length == 1 and sum(r.length for r in per[0]) == 2 * per[0][0].doc_tokens
    padding = 0
    for got in seqs.values():
        got.sort(key=lambda r: r.offset)
        assert [r.offset for r in got] == np.cumsum([0, *[r.length for r in got]])[:-1].tolist()
        n = sum(r.length for r in got)
        assert n == got[0].width <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding < 0.02 * sum(r.length for r in rows)
    order = [r.doc_id for r in rows]
    assert [x for i, x in enumerate(order) if i == 0 or x != order[i - 1]][: len(some)] == list(range(len(some)))
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).collect() == []


def test_cuts_are_optimal():
    """The monotone queue finds what the plain quadratic recurrence finds."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 60))])
        pen = rng.choice([0.0, 3.0, 9.0], len(x))
        cost = lambda cuts: sum(20 - (x[j] - x[i]) + pen[j] for i, j in zip(cuts, cuts[1:], strict=False))  # noqa: B023, E731
        best = [0.0] + [np.inf] * (len(x) - 1)
        for j in range(1, len(x)):
            best[j] = min(best[i] + 20 - (x[j] - x[i]) + pen[j] for i in range(j) if x[j] - x[i] <= 20)
        cuts = packing.cut_points(x, pen, 20).tolist()
        assert cuts[0] == 0 and cuts[-1] == len(x) - 1 and all(x[j] - x[i] <= 20 for i, j in zip(cuts, cuts[1:], strict=False))
        assert cost(cuts) == pytest.approx(best[-1])


def test_best_fit_rows(spark, texts):
    lib = Tokenizer.from_file(WORDS)
    some = [*texts, " ".join(["packing"] * 9000)]
    rows = best_fit.with_positions(best_fit.pack_rows(table(spark, some), WORDS)).collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        pos = best_fit.positions(r.cu_seqlens, 2048)
        assert all(pos[s] == 0 for s in r.position_resets) and pos.max() < 2048
        for i, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts.setdefault(i, {}).setdefault(s, []).append(ids[a:b])
    for i, t in enumerate(some):
        got = np.concatenate([parts[i][s][0] for s in sorted(parts[i])]).tolist()
        assert got == [*lib.encode(t, add_special_tokens=False).ids, 1]
    assert len(parts[0][0]) == 2 and parts[9000][0][0].tolist() == [1]
    d = best_fit.digest(best_fit.pack_rows(table(spark, some), WORDS)).collect()
    assert sorted(r.ids_crc32 for r in d) == sorted(zlib.crc32(bytes(r.ids)) for r in rows)
    assert best_fit.pack_rows(spark.createDataFrame([], SCHEMA), WORDS).collect() == []


def test_best_fit_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        n = [rng.randint(1, 64) for _ in range(80)]
        rooms, want = [], [0] * len(n)
        for i in sorted(range(len(n)), key=lambda i: -n[i]):  # noqa: B023
            fits = [r for r in rooms if r >= n[i]]
            room = min(fits) if fits else 64
            if fits:
                rooms.remove(room)
            rooms.append(room - n[i])
            want[i] = room - n[i]
        got = best_fit.best_fit(n, 64)
        fill = np.bincount(got, weights=n)
        assert fill.max() <= 64 and sorted(64 - fill) == sorted(rooms)


def test_written_rows_come_back(spark, tmp_path):
    import public_tokenizers as P

    from logweir.llm import best_fit

    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (None, None), (2, "more " * 5000)], "doc_id long, text string")
    rows = best_fit.pack_rows(docs, P.path("word_bpe_49k.json"))
    best_fit.write_rows(rows, str(tmp_path / "rows"))
    back = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert sum(r.n_tokens for r in back) == sum(r.n_tokens for r in rows.collect())
    assert all(len(r.ids) == 4 * 2048 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1] for r in back)
