"""Corpus operators against brute force on small fixtures, edge cases included."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilo.llm import bpe, chat, common, components, licenses, nearcopies, orc_tokens, packing, quality_cnn, quality_rules, queries, sharding, simhash, spotsigs
from vigilo.llm.wordbpe import WordEncoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", " \t\n", "word " * 3000, "É́ ß İ ſ 中文 ٣ ½", "x\x1cy\x85z\xa0w", "same", "same", "The the THE", "!!! ### $$$"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, " \t\n", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


# ---- 1 sharding


def test_schedule_equals_heap():
    import heapq

    rng = random.Random(1)
    for _ in range(60):
        hist = {rng.choice([1, 2, 3, 5, 8, 1000, 50000]): rng.randint(1, 500) for _ in range(5)}
        heap = [(0, k) for k in range(7)]
        for size in sorted(hist, reverse=True):
            for _ in range(hist[size]):
                load, k = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, k))
        loads = [0] * 7
        for size, given_ in sharding.schedule(list(hist.items()), 7):
            assert sum(given_) == hist[size]
            for k, n in enumerate(given_):
                loads[k] += n * size
        assert sorted(loads) == sorted(x for x, _ in heap)


def test_shards_whole(docs, real):
    for df in (docs, real):
        rows = sharding.lpt_shards(df).collect()
        assert len(rows) == df.count()
        slots, groups = collections.defaultdict(list), collections.defaultdict(set)
        for r in rows:
            slots[r.shard].append(r.slot)
            groups[r.text_crc32, r.size].add(r.shard)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in groups.values())
    assert sharding.lpt_shards(docs.limit(0)).count() == 0


# ---- 2 classifier, 5 rules


def test_classifier_scores_every_text_and_holds_out(spark, docs):
    model = quality_cnn.train(["good words here " * 20] * 20 + ["### $$$ " * 30] * 20, [1] * 20 + [0] * 20, 0.5, epochs=4)
    scored = quality_cnn.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.quality_score <= 1 for r in scored)
    assert quality_cnn.score_texts(model, ["good words here " * 20])[0] > 0.5 > quality_cnn.score_texts(model, ["### $$$ " * 30])[0]
    assert quality_cnn.train(["x"], [1], 1.0).offset > 0
    t = "abc def " * 2000
    assert quality_cnn.score_texts(model, [t, "q"])[0] == pytest.approx(quality_cnn.score_texts(model, [t])[0])
    data = bytes(range(256)) * 9
    assert b"".join(bytes(c[: quality_cnn.STEP].astype(np.uint8)) for c in quality_cnn.chunks(data))[: len(data) - 200] == data[: len(data) - 200]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op2_quality_cnn(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85
    rows = queries.op5_quality_rules(spark, sf).join(labels, "doc_id").where(quality_cnn.remainder() == 0).collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.85


def brute_measure(t):
    words = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    wins = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #\n\t\x0b\x1c\xa0é", max_size=60))
def test_measure_equals_brute_force(t):
    assert quality_rules.measure(t)[:5] == brute_measure(t)


def test_long_texts_measure_as_short_ones():
    rng = np.random.default_rng(4)
    words = [f"w{k}é#" if k % 50 == 0 else f"Wort{k}" for k in rng.integers(0, 30_000, 160_000)]
    passage = [*words[500:900], "same same same \x0b\f  same"]
    lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
    text = "\n".join([*lines, " ".join(passage), *lines[:300], "", " \t", " ".join(passage), "no no"])
    assert len(text) > common.SPAN
    tracemalloc.start()
    got = quality_rules.measure(text)
    held = nearcopies.shingles(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(text), peak / len(text)
    assert got[:5] == brute_measure(text) and got[4] > 800
    flat = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert got[5] == sum(1 for x in text.split("\n") if x.strip(" \t\x0b\f\r")) and got[7] == sum(a == b for a, b in zip(flat, flat[1:]))
    low = [w.encode().lower() for w in flat]
    assert set(held.tolist()) == {xxhash.xxh64_intdigest(b" ".join(low[i : i + 5])) for i in range(len(low) - 4)}
    blank = " \n" * common.SPAN
    assert quality_rules.measure(blank) == (0,) * 9 and not len(nearcopies.shingles(blank))
    assert quality_rules.measure(blank + "one word\none word") == (4, 14, 0, 1, 0, 2, 0, 0, 0)


def test_rows_cross_to_python_with_one_text(spark):
    """The first two stages of the pipeline send a row's text once to Python."""
    docs = spark.createDataFrame([(1, "x" * 1000, "en")], "doc_id long, text string, lang string")
    model = quality_cnn.train([], [], 0.5)
    for kept in (quality_cnn.keep_documents(docs, model, 0.0), quality_rules.keep_documents(docs, [])):
        mapped = next(x for x in _nodes(kept._jdf.queryExecution().analyzed()) if x.nodeName() == "MapInArrow")
        assert kept.columns == docs.columns and mapped.children().head().schema().sql().count("STRING") == 2  # text and lang


def _nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def test_rules_keep_columns_and_rows(spark, docs, real):
    got = quality_rules.judge(real, []).collect()
    want = texts_of(real)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measure(want[r.doc_id]) for r in got)
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("t", F.lit(1))
    kept = quality_rules.keep_documents(clash, [])
    assert kept.columns == clash.columns and quality_rules.judge(docs.limit(0), []).count() == 0
    rule = (quality_rules.Condition("symbols_per_word", True, 0.5),)
    assert "symbols_per_word" in str(rule[0])
    x = np.array([[0.9] + [0] * 5, [0.0] * 6] * 100)
    learned = quality_rules.learn(x, np.array([0, 1] * 100))
    assert len(learned) == 1 and learned[0][0].feature == "symbols_per_word"


# ---- 3 licenses


def test_license_scan_equals_containment(spark):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            name, text = rng.choice(licenses.TEMPLATES)
            t = text.split()
            if i % 2:
                t[len(t) // 2] = "changed"
            words[len(words) // 2 : len(words) // 2] = t
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "four words are few")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for i, t in rows:
        have = shingles(t)
        for k, (_, text) in enumerate(licenses.TEMPLATES):
            need = shingles(text)
            if len(need & have) / len(need) >= 0.8:
                want.add((i, k))
    got = {(r.doc_id, r.template) for r in licenses.scan(df).collect()}
    assert got == want
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.miss_chance(1) < 0.01


def test_license_scan_finds_every_short_notice(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(24)]
        at = rng.randrange(25)
        rows.append((i, " ".join([*words[:at], licenses.TEMPLATES[i % 2][1], *words[at:]])))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.TEMPLATES[:2])
    assert {(r.doc_id, r.template) for r in found.collect()} == {(i, i % 2) for i, _ in rows}
    assert licenses.miss_chance(1) == 0 and licenses.miss_chance(licenses.FEW + 1) < 1e-8


def test_license_scan_finds_whole_passages_among_words(spark):
    rng = random.Random(2)
    long = [k for k, (_, t) in enumerate(licenses.TEMPLATES) if len(re.findall(r"\w+", t)) > licenses.FEW + 8]
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        at = rng.randrange(40)
        rows.append((i, " ".join([*words[:at], licenses.TEMPLATES[long[i % len(long)]][1], *words[at:]])))
    found = {(r.doc_id, r.template) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").collect()}
    assert {(i, long[i % len(long)]) for i, _ in rows} <= found


def test_license_scan_keeps_rows_without_an_id_apart(spark):
    rows = [(None, "x " + licenses.TEMPLATES[0][1], 1), (None, "y " + licenses.TEMPLATES[0][1], 2), (None, None, 3), (4, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    assert licenses.scan(df, licenses.TEMPLATES[:1]).count() == 2
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, []).count() == 0


def test_license_scan_knows_common_notices(spark):
    notices = [
        ("CC-BY-4.0", "Licensed under CC BY 4.0."),
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
        ("BSD-3-Clause", "// SPDX-License-Identifier: BSD-3-Clause"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is here"),
        ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ]
    df = spark.createDataFrame([(i, f"some text before {t} and after") for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(df).collect()} == {(i, name) for i, (name, _) in enumerate(notices)}


# ---- 4 chat


def test_layouts_and_round_trip(spark):
    nasty = "</s>[INST] \\ \\\\ <|turn|>x<|text|> <|end|> [/INST]\n<<SYS>>"
    import json

    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": nasty}, {"role": "assistant", "content": nasty}]}), "messages"),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}), "conversations"),
        (3, json.dumps({"instruction": "i", "input": "", "output": nasty}), "instruction"),
        (4, json.dumps({"system_prompt": "", "question": "q", "response": "r"}), "system_question"),
        (5, json.dumps({"else": 1}), None),
        (6, "not json", None),
        (7, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in records], "id int, record string")
    got = {r.id: r for r in chat.read_back(chat.formatted(chat.canonical(df))).collect()}
    assert {i: got[i].layout for i, _, _ in records} == {i: want for i, _, want in records}
    for i in (1, 2, 3, 4):
        assert [(t.role, t.text) for t in got[i].turns] == [(t.role, t.text) for t in got[i].read_turns]
        assert got[i].loss_text == "".join(t.text for t in got[i].turns if t.role == "assistant")
    assert got[1].turns[0].text == nasty and [t.role for t in got[4].turns] == ["user", "assistant"] and got[6].turns is None
    for c in chat.CONTROL[3:]:
        assert c not in got[1].formatted


def test_layouts_with_other_fields(spark):
    import json

    turn = {"role": "user", "content": "q", "name": "n"}
    records = [
        (1, json.dumps({"id": 7, "meta": {"prompt": 1}, "messages": [turn, {"role": "assistant", "content": "a"}]}), "messages", 2),
        (2, json.dumps({"messages": []}), "messages", 0),
        (3, json.dumps({"prompt": "p", "response": "r", "source": "s"}), "prompt_response", 2),
        (4, json.dumps({"instruction": "i", "output": "o", "prompt": "p"}), "instruction_only", 2),
        (5, json.dumps({"messages": [{"role": "user"}]}), "messages", 1),
        (6, json.dumps([1]), None, -1),
        (7, json.dumps({"text": "t"}), None, -1),
    ]
    df = spark.createDataFrame([(i, r, "kept", "kept") for i, r, _, _ in records], "id int, record string, turns string, layout string")
    got = {r.id: r for r in chat.canonical(df).collect()}
    assert {i: (got[i].layout, len(got[i].turns) if got[i].turns is not None else -1) for i in got} == {i: (want, n) for i, _, want, n in records}
    assert all(r["turns_"] == r["layout_"] == "kept" for r in got.values())
    assert {r.shape: r.n for r in chat.unknown_layouts(df).collect()} == {"ARRAY<BIGINT>": 1, "OBJECT<text: STRING>": 1}
    assert chat.canonical(df.limit(0)).count() == 0


def test_chat_query_equals_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cur = db.execute(queries.ORACLES["op4_chat_format"])
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in queries.op4_chat_format(spark, SF).collect())


def test_conversations_are_dealt_over_the_layouts(spark):
    turns = {1: [("user", "a\n\nb"), ("assistant", "c")], 2: [("system", "s"), ("user", "q"), ("assistant", "")], 3: [("human", "x")]}
    rows = [(k * 50 + i, [(j, r, t) for j, (r, t) in enumerate(turns[k])]) for k in turns for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, held array<struct<turn:long,role:string,content:string>>")
    got = chat.canonical(df.select("conv_id", queries._dealt(F.col("held")).alias("record"))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {i: [(r, t) for _, r, t in held] for i, held in rows}
    assert {r.layout for r in got} == {m.name for m in chat.MAPPINGS}


def test_chat_query(spark):
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op4_chat_format(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        turns = sorted(rows[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# ---- 6 spot signatures


def test_fingerprints_of_edits(spark, docs, real):
    want = texts_of(real)
    ids = sorted(want)
    got = {r.doc_id: r for r in spotsigs.fingerprint_with_edits(real).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        t, nxt = want[i], want[ids[(k + 1) % len(ids)]]
        n = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        a, b, c = (set(x.split()) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint))
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
    assert spotsigs.fingerprint_with_edits(docs).count() == docs.count()
    assert spotsigs.fingerprint_with_edits(docs.limit(1)).count() == 1
    assert spotsigs.fingerprint_with_edits(docs.limit(0)).count() == 0


def test_near_pairs_equal_brute_force(spark, real):
    base = [r.text for r in real.orderBy("doc_id").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " and then the extra words come") for i, t in enumerate(base[:15])] + [(200, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {r.doc_id: frozenset(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sigs):
        first.setdefault(sigs[i], i)
    reps = sorted(first.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if sigs[a] and sigs[b] and len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.8}
    pairs, members = spotsigs.near_pairs(df, 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[s] for i, s in sigs.items()}


# ---- 7 SimHash


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbB \n\x1cé", max_size=40))
def test_fingerprint_equals_brute_force(t):
    assert simhash.fingerprint(t) == brute_fingerprint(t)


def brute_components(fps, bits=2):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    u = sorted(set(fps.values()))
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps.items():
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in fps.items()}


@pytest.mark.parametrize("bits, seed", [(2, 4), (2, 1000), (1, 4)])
def test_components_equal_brute_force(spark, bits, seed):
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    fam = []
    for _ in range(150):
        x = base
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.choice([0, 5, 17, 31, 32, 44, 63])
        fam.append(x)
    fam += [rng.getrandbits(64) for _ in range(50)]
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fam)]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, fp long"), bits)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(dict(enumerate(fam)), bits)


def test_simhash_query_and_dedup(spark, docs, real):
    got = simhash.simhash_components(real).collect()
    fps = {i: brute_fingerprint(t) for i, t in texts_of(real).items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    assert simhash.simhash_components(docs).count() == docs.count() and simhash.simhash_components(docs.limit(0)).count() == 0
    kept = nearcopies.near_dedup(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 8 not in ids and 7 in ids


def test_near_dedup_drops_near_copies_only(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(4000)]
    base = [[rng.choice(vocab) for _ in range(300)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        w = list(w)
        w[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(w)))
    kept = {r.doc_id for r in nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept and len(kept) <= 62


def test_near_dedup_finds_copies_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for k, run in enumerate((0, 20, 27, 40)):  # of 296 shingles run + 4 change: Jaccard 0.85, 0.81 and 0.74
            at = rng.randrange(5, 250)
            rows.append((i + 100 * k, " ".join([*base[:at], *(f"x{k}{i}{j}" for j in range(run)), *base[at + run :]])))
    kept = {r.doc_id for r in nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows if i < 100 or i >= 300}


def test_near_dedup_compares_texts_not_word_sets(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(reversed(words))), (3, " ".join(words * 3)), (4, " ".join(w for w in words for _ in range(2)))]
    assert {r.doc_id for r in nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2, 4}
    chain = [" ".join([f"y{j}" for j in range(15 * k)] + words[15 * k :]) for k in range(3)]  # 0 and 1, 1 and 2 are alike, 0 and 2 are not
    assert [r.doc_id for r in nearcopies.near_dedup(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).collect()] == [0]


def brute_near_kept(texts, threshold=0.8):
    """Ids that stay where all pairs of five-word shingle sets are compared."""
    sets = {}
    for i, t in sorted(texts.items()):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders, root = collections.defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [i for i, s in sets.items() if not s]
    pairs = {(empty[0], i) for i in empty[1:]}
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x]).items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                pairs.add((j, i))
        for x in s:
            holders[x].append(i)
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in sets if find(i) == i}, pairs


def test_near_dedup_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    family = []
    for i in range(120):  # one large group, at 0.5 to 1 to each other
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        family.append((10**6 + i, " ".join(t)))
    df = df.unionByName(spark.createDataFrame(family, "doc_id long, text string"))
    want, pairs = brute_near_kept(texts_of(df))
    assert len(pairs) > 500 and {r.doc_id for r in nearcopies.near_dedup(df).collect()} == want


def test_near_dedup_compares_crowded_bands(spark):
    rng = random.Random(21)
    rows = []
    for family, edits in enumerate((13, 14)):  # most pairs differ by a little more than the threshold, few are links
        base = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
        for k in range(200):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(1000)] = f"x{rng.randrange(10**8)}"
            rows.append((family * 1000 + k, " ".join(t)))
    want, pairs = brute_near_kept(dict(rows))
    kept = {r.doc_id for r in nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == want and len(pairs) > 100 and len(want) > 100


def test_blocks_join_as_pairs_do():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 300)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.1], rng.integers(0, 1 << 62, int(rng.integers(0, 20)))])) for _ in range(90)]
    labels = [k % 40 for k in range(90)]
    for blocks in ([0] * 90, [k % 2 for k in range(90)]):
        cell = pa.table({"block": blocks, "vid": list(range(90)), "label": labels, "s": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
        got = list(zip(*nearcopies._joined(cell, 0.8).to_pydict().values()))
        near = {}
        for i in range(90):
            for j in range(i + 1, 90):
                n = len(np.intersect1d(sets[i], sets[j]))
                if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8 and labels[i] != labels[j] and (len(set(blocks)) == 1 or blocks[i] != blocks[j]):
                    near[i, j] = True

        def parts(pairs):
            root = list(range(40))
            for i, j in pairs:
                a, b = root[labels[i]], root[labels[j]]
                root = [min(a, b) if x in (a, b) else x for x in root]
            return root

        assert parts(got) == parts(near) and all(tuple(sorted(p)) in near for p in got) and len(got) == 40 - len(set(parts(near)))


def test_near_dedup_passes_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, 6, None), (2, "A b c d e f", 7, 8, None), (3, None, 9, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __row long, `first.id` int")
    kept = nearcopies.near_dedup(df)
    assert kept.columns == df.columns and sorted(tuple(r)[0::2] for r in kept.collect()) == [(1, 5, None), (3, 9, 0)]
    assert nearcopies.near_dedup(df.limit(0)).count() == 0


def test_near_dedup_judges_each_row(spark):
    far = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = [t.replace(f"{c}59", "other") for c, t in zip("abcdef", far)]
    # A null id alone in its group stays; null-id copies of rows with ids go.  A repeated id keeps the texts that are not near.
    rows = [(None, far[0]), (1, far[1]), (None, near[1]), (None, far[1]), (7, far[2]), (7, far[3]), (5, near[3]), (8, far[4]), (8, far[5]), (9, far[5]), (9, far[5]), (None, near[0])]
    kept = sorted((r.doc_id or 0, r.text) for r in nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    alone = [t for i, t in kept if not i]
    assert len(alone) == 1 and alone[0] in (far[0], near[0])
    assert kept[1:] == sorted([(1, far[1]), (7, far[2]), (5, near[3]), (8, far[4]), (8, far[5])])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (300, 301)], "u long, v long")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[301] == 300


# ---- 8, 9, 10 tokens


@pytest.fixture(scope="module")
def word_encoder():
    return WordEncoder(queries.WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aZéßÉ .,'sdtİſσΣ½²\n\t\x1c\x85\xa0|#中٣́🙂<>")), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_word_encoder_equals_library(word_encoder, t):
    assert np.frombuffer(word_encoder.encode_batch([t])[0], "<u4").tolist() == word_encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_orc_round_trip(spark, docs, real, word_encoder, tmp_path):
    for k, df in enumerate((docs.where("doc_id is not null").dropDuplicates(["doc_id"]), real)):
        path = str(tmp_path / str(k))
        orc_tokens.write_tokens(df, path, queries.WORD_BPE)
        got = {r.doc_id: r for r in orc_tokens.token_digest(orc_tokens.read_tokens(spark, path)).collect()}
        at = 0
        for i, t in sorted(texts_of(df).items()):
            ids = [*word_encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert orc_tokens.read_tokens(spark, path, [5]).count() == 1
    orc_tokens.write_tokens(docs, str(tmp_path / "odd"), queries.WORD_BPE)
    assert orc_tokens.read_tokens(spark, str(tmp_path / "odd")).count() == docs.count()
    orc_tokens.write_tokens(docs.limit(0), str(tmp_path / "none"), queries.WORD_BPE)
    assert orc_tokens.token_digest(orc_tokens.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def check_packing(rows, capacity):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_is_gapless_and_tight(spark, docs, real):
    for df in (docs, real):
        rows = packing.pack_documents(df, queries.WORD_BPE).collect()
        n = check_packing(rows, packing.CAPACITY)
        assert len({(r.doc_id, r.piece, r.start) for r in rows}) >= df.select("doc_id").distinct().count() - 1
        assert n <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 2
    assert packing.pack_documents(docs.limit(0), queries.WORD_BPE).count() == 0


def test_local_search_never_adds_bins():
    rng = random.Random(6)
    for _ in range(20):
        lengths = [rng.randint(1, 2048) for _ in range(300)]
        start = packing.best_fit(lengths, 2048)
        before = sum(sum(lengths[i] for i in b) ** 2 for b in start)
        end = packing.improve([list(b) for b in start], lengths, 2048)
        assert sorted(i for b in end for i in b) == list(range(300)) and len(end) <= len(start)
        assert all(sum(lengths[i] for i in b) <= 2048 for b in end) and sum(sum(lengths[i] for i in b) ** 2 for b in end) >= before


@pytest.fixture(scope="module")
def byte_ranks():
    return bpe.Ranks(queries.BYTE_RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aZé '.sdt½²\n\t\x1c\x85\xa0_中٣́🙂×ª")), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_pretokens_encode_as_the_library(byte_ranks, t):
    assert [i for w in bpe.pretokens(t) for i in byte_ranks.encode_word(w)] == byte_ranks.encoding.encode_ordinary(t)


def test_byte_bpe_round_trip(spark, docs, real, byte_ranks):
    for df in (docs, real):
        rows = bpe.encode(df, queries.BYTE_RANKS).collect()
        assert len(rows) == df.count()
        want = texts_of(df)
        for r in rows:
            if r.doc_id is not None:
                assert bytes(r.decoded).decode() == want[r.doc_id] and r.ids == byte_ranks.encoding.encode_ordinary(want[r.doc_id])
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, SF).collect()}
    want = texts_of(real)
    for i, t in want.items():
        ids = byte_ranks.encoding.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), queries.BYTE_RANKS).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids and 0.5 * docs.count() < len(ids) < docs.count()
    check_packing(rows, packing.CAPACITY)
