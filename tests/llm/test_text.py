import hashlib
import random
import re
import zlib

import numpy as np

from logweir.llm import decontam, licenses, quality, queries, secrets, toxicity
from logweir.llm.decontam import Decontaminator, Items, normal

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, label string, score double, x array<double>, contaminated int"


def odd(spark):
    long = "Licensed under CC BY 4.0.\n" + "plain words go on. " * 20_000
    return spark.createDataFrame([(1, None, None, None, None, None), (2, "", "a", 1.0, [1.0], 1), (None, "idiot here", "a", 1.0, None, 1), (3, long, "a", 1.0, None, 1), (3, long, "a", 1.0, None, 1), (4, "x", None, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def check_classifier(spark, query, target, mod, rest, at, least, directory="/root/testdata/sf0.1"):
    out = query(spark, directory)
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    got = out.join(labels, "doc_id").toPandas()
    assert out.count() == spark.read.parquet(f"{directory}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % mod == rest) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert got.score.between(0, 1).all() and ((got.score >= at).astype(int) == got.predicted).all()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held[target].to_numpy()) >= least


def test_quality_on_held_out_rows(spark):
    check_classifier(spark, queries.op1_bradley_terry, "quality", 3, 1, 0.5, 0.97)


def test_toxicity_on_held_out_rows(spark):
    check_classifier(spark, queries.op9_noisy_or, "toxic", 4, 2, 0.3, 0.95)


def test_classifiers_take_anything(spark):
    labels = spark.createDataFrame([(3, 1, 0, "z"), (3, 1, 0, "z"), (4, 0, 1, "z"), (None, 1, 1, "z"), (2, None, None, "z")], "doc_id long, quality int, toxic int, label string")
    for f, k in ((quality.quality, "quality"), (toxicity.toxicity, "toxic")):
        for lab in (labels, labels.where("1 = 0"), labels.where("doc_id = 3")):
            got = f(odd(spark), lab).collect()
            assert len(got) == 6 and all(0 <= r.score <= 1 for r in got), k
        assert f(empty(spark), labels.where("1 = 0")).collect() == []
    one = toxicity.ToxicityClassifier().fit(odd(spark), labels.where("1 = 0")).clean(odd(spark))
    assert one.count() == 6 and one.columns == odd(spark).columns


def test_noisy_or_of_sentences():
    m = toxicity.train(["all is well. you idiot go. fine day", "good day. nice sun", "a moron spoke. ok", "the sun is nice"] * 30, [1, 0, 1, 0] * 30, zmin=2)
    text = "calm words here. you idiot go. calm again"
    at, p = m.sentences(text)
    s, n, worst, _ = m.score(text)
    assert s == np.float64(1 - np.prod(1 - p)).item() or abs(s - (1 - np.prod(1 - p))) < 1e-12
    assert text[worst:].lstrip().startswith("you idiot") and len(at) == 3 and s > 0.3 and m.score("nice sun")[0] < 0.3


def base(text):
    """The contract's rules, plainly."""
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_secrets(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rng = random.Random(1)
    for i in range(300):
        docs[10_000 + i] = "".join(rng.choice(["token", "API_KEY", "ſecret", "password", " ", "=", ":", '"', "AKIA", "AB12CD34EF56", "deadbeef", "0123456789abcdef", "ü", "x9_", "\n"]) for _ in range(40))
    d = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, text string")
    for r in secrets.find_secrets(d).collect():
        want = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{s}:{e}" for k, s, e in want}


def test_novelty():
    secret = "zR8xKq0ffT51PvLwm3Yc9B2n"
    found = secrets.scan(f'auth_key: "{secret}" and later auth_key: "{"a1" * 14}"')
    assert [(k, e - s) for s, e, k in found] == [("novel", len(secret))]
    assert secrets.scan("the session id is documented in configuration_parameter_reference_2") == []
    assert secrets.redact("a SECRET=abcdefgh12 b", secrets.scan("a SECRET=abcdefgh12 b")) == "a [SECRET] b"


def test_secret_edges(spark):
    got = secrets.find_secrets(odd(spark)).collect()
    assert len(got) == 6 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.find_secrets(empty(spark)).collect() == []
    out = secrets.redact_secrets(odd(spark))
    assert out.columns == odd(spark).columns and sorted(map(str, out.collect())) == sorted(map(str, odd(spark).collect()))


def test_decontamination_finds_edited_passages(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    items = Items([b[0] for b in bench], [normal(b[1]) for b in bench], 80, 0.08)
    docs = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(120).collect()]
    rng = random.Random(3)
    for k in range(60):
        i, text = rng.choice(bench)
        t = list(text)
        for _ in range(int(len(t) * 0.05)):
            p, op = rng.randrange(len(t)), rng.randrange(3)
            if op == 0:
                t[p] = rng.choice("abcxyz")
            elif op == 1:
                t.insert(p, rng.choice("abc"))
            elif len(t) > 20:
                del t[p]
        around = rng.choice(docs)
        at = rng.randrange(len(around))
        found = items.found(around[:at] + " " + "".join(t) + " " + around[at:])
        assert i in {items.ids[v[0]] for v in found}
    for t in docs:  # nothing is found where no long stretch is shared
        found = items.found(t)
        if found:
            data = normal(t)
            assert any(items.texts[m][j : j + 24] in data for m, _, _ in found for j in range(0, len(items.texts[m]) - 23))


def test_banded_alignment_against_plain():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -3), h[i - 1, j] - 3, h[i, j - 1] - 3)
        return h.max()

    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = (rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint8) for _ in range(2))
        assert decontam.banded(a, b, 0, 60)[0] == plain(a, b)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog while nobody watches the garden at all."), (2, None), (3, "short"), (None, "x" * 90), (4, "")], "item_id long, text string")
    passage = "intro THE  quick brown fox jumps\nover the lazy dog while nobody watches the garden at all. outro"
    d = odd(spark).unionAll(spark.createDataFrame([(50, passage, None, None, None, None)], DOCS))
    for dec in (Decontaminator(), Decontaminator(slice_bytes=40)):
        got = {r.doc_id: r for r in dec.find(d, bench).collect()}
        assert {k for k, r in got.items() if r.contaminated} == {50} and got[50].item_ids == [1]
        left = dec.clean(d, bench)
        assert left.columns == d.columns and left.count() == 6
    assert Decontaminator().find(d, bench.where("1 = 0")).where("contaminated").count() == 0
    assert Decontaminator().find(empty(spark), bench).collect() == []


def test_licences_against_plain_python(spark):
    m = licenses.train()
    for f, texts in licenses.TEMPLATES.items():
        assert all(any(a in t.lower() for a in licenses.ANCHORS) or "spdx" in t.lower() for t in texts)
        assert all(m.predict(t)[0] == f for t in texts)
    assert all(m.predict(t)[0] == licenses.UNKNOWN or m.predict(t)[1] < 0.5 for t in licenses.OTHER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    docs[77_777] = "Released under the MIT License.\nShe renewed her driver license.\nRELEASED UNDER THE MIT LICENSE."
    n = 0
    for r in licenses.notices(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        want = []
        for i, p in enumerate(docs[r.doc_id].split("\n")):
            if any(a in p.lower() for a in licenses.ANCHORS):
                f, prob, over = m.predict(p)
                if f != licenses.UNKNOWN and prob >= 0.5:
                    want.append((i, f, round(prob, 9), round(over, 9)))
        assert [(x.paragraph, x.family, round(x.probability, 9), round(x.overlap, 9)) for x in r.notices] == want
        n += len(want)
    assert n > 10


def test_licence_plan_is_native(spark):
    plan = licenses.notices(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licence_edges(spark):
    got = licenses.notices(odd(spark)).collect()
    assert sorted(r.n_notices for r in got) == [0, 0, 0, 0, 1, 1] and {tuple(r.families) for r in got} == {(), ("cc-by",)}
    assert licenses.notices(empty(spark)).collect() == []


def test_novelty_of_values_after_names():
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    pad = "q8Zt1LwX0vRk5HnB7cYs3A=="
    for name, value, end in (("export AWS_SECRET_ACCESS_KEY=", aws, "\n"), ("?user=me&auth=", aws, "&x=1"), ("SESSION=", pad, ";"), ("PRIVATE_KEY=", f"{pad}", "")):
        text = name + value + end
        assert secrets.redact(text, secrets.scan(text)) == name + "[SECRET]" + end


def test_novelty_of_short_dotted_and_digitless_values():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    for name, value, end in (("session_key = '", "k9XvQ2mZr7LpT4wBs8", "'"), ('private_key: "', "QwErTyUiOpAsDfGhJkLzXcVb", '"'), ("DB_PWD=", "x7Kq9ZmW2pLr5TvN", "\n"), ("Authorization: Bearer ", jwt, ".")):
        text = name + value + end
        assert secrets.redact(text, secrets.scan(text)) == name + "[SECRET]" + end
    for text in ("Author: Shakespeare wrote", "the secret ingredient is", "Monkey: chimpanzee", "private ConcurrentHashMap<String>", "session: 2024-05-12", "public key cryptosystem", "session = requests.Session()", "primary key: customer_id"):
        assert secrets.scan(text) == []


def test_wrapped_licences(spark):
    mit = "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction, including without limitation the rights"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or"
    inside = "The weather was fine and the boat left early. " * 8 + "Released under the MIT License. " + "They came home late and slept until noon. " * 8
    bare = "This work is under a Creative Commons Attribution 4.0 International"
    texts = [mit, bsd, gpl, "Some title\n//\n" + mit + "\n//\n\n" + bsd, inside, bare, "\n\n".join(licenses.OTHER), "\n".join(licenses.OTHER)]
    want = [[(0, "mit")], [(0, "bsd")], [(0, "gpl")], [(2, "mit"), (7, "bsd")], [(0, "mit")], [(0, "cc-by")], [], []]
    rows = licenses.notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[(n.paragraph, n.family) for n in r.notices] for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_slices_give_the_same_rows(spark):
    a, b = ("The quick brown fox jumps over the lazy dog while nobody watches the garden at all.", "Seven wizards quietly mixed a jar of fuzzy black powder behind the old stone bridge.")
    bench = spark.createDataFrame([(1, a), (2, b), (10, a)], "item_id long, text string")
    texts = [f"x {b} y {a} z", "clean text", None, a]
    docs = spark.createDataFrame([(i, t) for i in (None, 5) for t in texts], "doc_id long, text string")
    whole, sliced = (sorted(map(str, Decontaminator(slice_bytes=n).find(docs, bench).collect())) for n in (16 << 20, 100))
    assert whole == sliced and len(whole) == 8 and sum("contaminated=True" in r for r in whole) == 4
