"""Tokenizer alignment, toxicity and fill-in-the-middle against plain versions, with edge cases."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilo.llm import align, fim, orc_tokens, packing, quality_rules, queries, toxicity
from vigilo.llm.wordbpe import byte_letters

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", " \t\n", "word " * 3000, "É́ ß İ ſ 中文 ٣ ½", "x\x1cy\x85z\xa0w", "same", "same", "<P>", "a<S>b<M>c", "<<P", "😀" * 700]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, " \t\n", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


# ---- 11 alignment


@pytest.fixture(scope="session")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def brute_groups(coders, text):
    """Whole texts through both libraries; groups end where tokens of both do."""
    if not text:
        return []
    a, b = coders
    letters = {c: k for k, c in enumerate(byte_letters())}
    got_a = [(t.ids[k], bytes(letters[c] for c in t.tokens[k])) for t in [a.encode(" " + text, add_special_tokens=False)] for k in range(len(t.ids))]
    got_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        hexed = re.fullmatch("<0x(..)>", piece)
        got_b.append((i, bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in got_a) != whole or b"".join(x for _, x in got_b) != whole:
        return []
    ends = []
    for tokens in (got_a, got_b):
        n, at = 0, {}
        for k, (_, data) in enumerate(tokens):
            n += len(data)
            at[n] = k + 1
        ends.append(at)
    out, i, j = [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        out.append((tuple(x for x, _ in got_a[i : ends[0][e]]), tuple(x for x, _ in got_b[j : ends[1][e]])))
        i, j = ends[0][e], ends[1][e]
    return out


def brute_alignment(coders, rows):
    groups = [(i, brute_groups(coders, t)) for i, t in rows]
    count = collections.Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(line.encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str)


def test_alignment_equals_whole_texts(spark, coders, docs):
    rng = random.Random(5)
    parts = ["a", "the ", " ", "  ", "\n", "\t", "\r", "\xa0", "　", "\x1c", "\x85", "▁", "é", "é", "中", "😀", "'s", "don't", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "12", "!?", "foo", "ing ", "​", "ﬁ", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(600)] + [(900, None), (901, ""), (902, " "), (903, "▁")]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_BPE, queries.PIECES)
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(coders, rows)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, align.align(docs, queries.BYTE_BPE, queries.PIECES).collect()), key=str) == brute_alignment(coders, rows)
    assert align.align(docs.limit(0), queries.BYTE_BPE, queries.PIECES).count() == 0


def test_alignment_query_and_small_packs(spark, coders, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_alignment(coders, rows)
    assert sorted(map(tuple, queries.op11_alignment(spark, SF).collect()), key=str) == want
    worker = align.Aligner(queries.BYTE_BPE, queries.PIECES)
    monkeypatch.setattr(align, "KEEP", 50)
    for at in range(0, len(rows), 7):  # the worker forgets between packs
        numbers, counts, lines = worker.pack([t for _, t in rows[at : at + 7]])
        assert [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines] == [next(w[-1] for w in want if w[0] == i) for i, _ in rows[at : at + 7]]
        assert [x.count(";") + bool(x) for x in lines] == counts.tolist() and counts.sum() == len(numbers)


def test_alignment_writes_groups_and_dictionary(spark, coders):
    rows = [(1, "the cat"), (2, "the cat"), (3, "a cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit("mine"))
    got = {r.doc_id: r for r in align.align(df, queries.BYTE_BPE, queries.PIECES, written=True).collect()}
    for i, t in rows:
        assert [tuple(tuple(map(int, s.split(","))) for s in g.split("|")) for g in got[i].groups.split(";")] == brute_groups(coders, t)
    listed = align.dictionary(align.packs(df, queries.BYTE_BPE, queries.PIECES))
    want = collections.Counter(g for _, t in rows for g in brute_groups(coders, t))
    assert {r.group: (r.n, r.a, r.b) for r in listed.collect()} == {",".join(map(str, a)) + "|" + ",".join(map(str, b)): (n, a[-1], b[-1]) for (a, b), n in want.items()}


# ---- 12 toxicity


def test_risk_gradient_is_the_slope_of_the_risk():
    rng = np.random.default_rng(0)
    p, u = rng.normal(0.5, 1, (30, 4)), rng.normal(0, 1, (80, 4))
    sig = lambda z: 1 / (1 + np.exp(-z))
    seen = set()
    for prior in (0.1, 0.9):
        w, b = rng.normal(0, 1, 4), 0.3
        g, gb, upper = toxicity.risk_gradient(p, u, w, b, prior)
        seen.add(upper)

        def risk(w, b, prior=prior, upper=upper):
            negative = sig(u @ w + b).mean() - prior * sig(p @ w + b).mean()
            return prior * sig(-(p @ w + b)).mean() + negative if upper else -negative

        for k in range(4):
            e = np.eye(4)[k] * 1e-6
            assert g[k] == pytest.approx((risk(w + e, b) - risk(w - e, b)) / 2e-6, abs=1e-6)
        assert gb == pytest.approx((risk(w, b + 1e-6) - risk(w, b - 1e-6)) / 2e-6, abs=1e-6)
        assert upper == (sig(u @ w + b).mean() - prior * sig(p @ w + b).mean() >= 0)
    assert seen == {True, False}


def test_training_tells_positives_from_the_unlabelled():
    rng = np.random.default_rng(1)
    toxic = rng.random(600) < 0.2
    x = np.zeros((600, 6), np.float32)
    x[:, 0] = toxic * (rng.random(600) < 0.9)
    x[:, 1:] = rng.random((600, 5)) < 0.3
    pos = np.concatenate([(rng.random((150, 1)) < 0.9), rng.random((150, 5)) < 0.3], axis=1).astype(np.float32)
    w, b = toxicity.train(pos, x, 0.2)
    flagged = x @ w + b > 0
    assert (flagged == (x[:, 0] > 0)).mean() > 0.97 and toxicity.train(pos[:0], x, 0.2)[1] == toxicity.BIAS


def brute_score(model, text):
    got = toxicity.marks(text or "")
    z = model.bias + sum(model.weights[m.rpartition(" ")[0]][int(m.rpartition(" ")[2]) - 1] for m in got if m.rpartition(" ")[0] in model.weights)
    return 1 / (1 + np.exp(-z))


def test_toxicity_scores_whole_texts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(real, labels)
    assert model.weights
    tail = "calm words here " * 4000 + "idiot moron scum trash loser " * 300
    more = docs.unionByName(spark.createDataFrame([(99, tail, None, None, None)], SCHEMA)).withColumn("toxicity_score", F.lit("mine"))
    got = toxicity.score(more, model).collect()
    assert len(got) == docs.count() + 1 and all(r["toxicity_score_"] == "mine" for r in got)
    assert all(r.toxicity_score == pytest.approx(brute_score(model, r.text)) for r in got)
    assert {r.toxicity_score > 0.5 for r in got if r.doc_id == 99} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels_and_with_only_toxic_ones(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) == toxicity.Model() and toxicity.fit(docs.limit(0), none) == toxicity.Model()
    real = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
    repeated = toxic.unionByName(toxic).unionByName(spark.createDataFrame([(None, 1, 1)], toxic.schema))
    assert toxicity.fit(real, repeated).weights.keys() == toxicity.fit(real, toxic).weights.keys()


def test_toxicity_held_out_accuracy_and_labels_out_of_the_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op12_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    twisted = labels.withColumn("toxic", F.when(toxicity.remainder() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, twisted)
    assert one.bias == pytest.approx(two.bias) and one.weights.keys() == two.weights.keys()


# ---- 13 fill-in-the-middle


def brute_fim(doc_id, text):
    n = len(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 10**12), st.text(alphabet="<>PSMa é中😀\x80￿", max_size=1500)), max_size=8))
def test_fim_equals_slicing(rows):
    form, out, found, low, high = fim.transform([i for i, _ in rows], [t.encode() for _, t in rows])
    for k, (i, t) in enumerate(rows):
        cut = form[k] != "plain"
        assert (int(found.units[k]), form[k], int(low[k]) if cut else None, int(high[k] - low[k]) if cut else None, out[k].decode()) == brute_fim(i, t)
        assert fim.restore(out[k], form[k]).decode() == t


def test_scan_counts_from_any_chunking():
    text = "<P> <<S> <M é中😀<M>".encode() * 40
    want = (len(text.decode()), len(re.findall("<[PSM]>", text.decode())))
    for chunk in (1, 2, 3, 5, 64, 10_000):
        found = fim.scan([b"", text, b"a"], chunk)
        assert (found.units[1], found.marks[1]) == want and found.units.tolist()[::2] == [0, 1]
        units = np.arange(want[0] + 1)
        cuts = fim.byte_cuts(found, np.ones(len(units), np.int64), units)
        assert [text[:c].decode() for c in cuts] == [text.decode()[:u] for u in units]


def test_fim_table(spark, docs):
    clash = docs.withColumn("form", F.lit("mine")).withColumn("n", F.lit(1))
    got = fim.fill_in_middle(clash).collect()
    assert len(got) == docs.count() and all(r["form_"] == "mine" and r["n_"] == 1 for r in got)
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text or "") for r in got)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    for r in fim.fill_in_middle(docs, digest=True).collect():
        assert r.restored_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for t in [*ODD, "no id"]}


def test_fim_query_equals_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = db.execute(queries.ORACLES["op13_fim"])
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in queries.op13_fim(spark, SF).collect())


# ---- repairs to earlier operators


def test_start_of_repeated_ids_is_their_place_in_the_file(spark, tmp_path):
    rows = [(7, "one two three four"), (7, "one"), (7, "one two"), (3, "a b"), (9, "z"), (None, "n")]
    path = str(tmp_path / "orc")
    orc_tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, queries.WORD_BPE)
    read = orc_tokens.read_tokens(spark, path)
    place, want = 0, []
    for r in sorted(read.collect(), key=lambda r: (r.block, r.row)):
        want.append((r.doc_id, place, len(r.ids)))
        place += len(r.ids)
    got = [(r.doc_id, r.start, r.n_tokens) for r in orc_tokens.token_digest(read).orderBy("start").collect()]
    assert got == want and [w[0] for w in want] == [None, 3, 7, 7, 7, 9]


def test_rules_take_names_with_dots(spark):
    df = spark.createDataFrame([(1, "word " * 30, "x")], ["doc_id", "text", "a.b"])
    assert quality_rules.keep_documents(df.withColumn("text", F.concat_ws(" ", *(F.lit(f"w{i}") for i in range(30)))), []).columns == ["doc_id", "text", "a.b"]


def test_packing_goes_on_while_bins_fall(spark):
    rng = random.Random(2)
    sizes = [rng.randint(300, 1100) for _ in range(3000)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    apart = packing.pack(df, group_pieces=250).select("sequence_id").distinct().count()
    whole = packing.pack(df, group_pieces=5000).select("sequence_id").distinct().count()
    assert apart <= whole * 1.005 + 1
    alike = spark.createDataFrame([(i, 0, 0, 1100, 0) for i in range(600)], df.schema)
    assert packing.pack(alike, group_pieces=100).select("sequence_id").distinct().count() == 600


def test_near_dedup_finds_the_links_of_random_trees(spark):
    """Families whose texts are each made from a random earlier one by three edits; brute force over all pairs says which stay."""
    from vigilo.llm import nearcopies

    rng = random.Random(12)
    rows = []
    for family in range(4):
        made = [[f"w{rng.randrange(10**6)}" for _ in range(200)]]
        for _ in range(149):
            t = list(rng.choice(made))
            for _ in range(3):
                t[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
            made.append(t)
        rows += [(family * 1000 + k, " ".join(t)) for k, t in enumerate(made)]
    sets = {i: set(nearcopies.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if a // 1000 == b // 1000 and find(a) != find(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})
