"""The text operators against brute force and the libraries themselves, with nulls, empties, ties and repeats."""

import base64
import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P

from cadenza.llm import chat, chunks, exact_dedup, hamming, near_dup, packing, pieces, queries, suffix_dedup, token_files, toxicity, warc

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
TEXTS = [None, "", " ", "  a  b", "a\n b", "é é\xa0x", "日本 語 😀", "</s>[INST] x\\y", "it's we'll 12 345", "▁a ▁ b", "x" * 3000, "a b " * 900, " q", "a\x1cb c", "tail ", "same text here", "same text here"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Texts with a null id, clashing extra columns and a repeated row, read from files."""
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", "y", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, digest string, slice string, node int").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("e") / "documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(path)
    return spark.read.parquet(path)


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_escape_is_reversible():
    rng = np.random.default_rng(0)
    for _ in range(500):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "a", "<", "[", "/"], size=rng.integers(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat(spark, empty):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST]\\"), (1, 2, "tool", None), (2, 0, None, ""), (None, None, "assistant", "x"), (1, 1, "assistant", "[INST]\\")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.write_conversations(chat.format_conversations(df, RANKS, PATTERN)), RANKS, PATTERN).collect()}
    assert got[1].n_turns == 4 and got[1].loss_sha256 == hashlib.sha256(b"[INST]\\[INST]\\").hexdigest() and got[1].loss_chars == 14
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi </s>\nassistant\n[INST]\\\nassistant\n[INST]\\\ntool\n\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 1
    none = chat.format_conversations(df.limit(0), RANKS, PATTERN)
    assert chat.conversation_digests(none, RANKS, PATTERN).collect() == []


def test_sentencepiece(table, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = pieces.encode_texts(table, P.path("piece_bpe_32k.model"), ["ids", "decoded"]).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        if r.doc_id is not None:
            ids = sp.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
            assert r.ids == ids and r.decoded == sp.decode(ids)
    assert pieces.encode_texts(empty, P.path("piece_bpe_32k.model")).collect() == []


def test_token_files(spark, table, empty, tmp_path):
    out, t, start = f"file://{tmp_path}/t", tokenizer("word_bpe_49k.json"), 0
    token_files.write_token_files(table, out, P.path("word_bpe_49k.json"), 2)
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(len(TEXTS))]
    for r in got:
        ids = t.encode("null id" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), u32(ids))
        start += len(ids)
    assert token_files.get_document(out, 5).tolist() == np.frombuffer(got[6].ids, "<u4").tolist() and token_files.get_document(out, 999) is None
    token_files.write_token_files(empty, f"{out}-e", P.path("word_bpe_49k.json"), 2)
    assert token_files.read_token_files(spark, f"{out}-e").collect() == []


def test_exact_dedup(table, empty):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table).collect()}
    assert got[0] == (1, 2, False) and got[1] == (1, 2, True) and got[15] == (16, 2, False) and got[3] == (3, 1, True) and got[None] == (None, 1, True)
    assert exact_dedup.exact_dedup(empty).collect() == []


@pytest.mark.parametrize("blocks", [500_000, 30])
def test_hamming(spark, blocks, monkeypatch):
    monkeypatch.setattr(hamming, "LEAST_ROWS", min(1000, blocks))
    rng = np.random.default_rng(3)
    codes = rng.integers(-(2**63), 2**63 - 1, 300).tolist() + [7] * 40
    df = spark.createDataFrame([*enumerate(codes), (None, 5)], "id bigint, code bigint")
    got = {(r.query_id, r["rank"]): (r.distance, r.neighbor_id) for r in hamming.top_k(df, df.where("id % 20 = 0"), 5, block_rows=blocks, query_rows=blocks).collect()}
    for q in range(0, 340, 20):
        near = sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in enumerate(codes) if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == near
    assert hamming.top_k(df.limit(0), df, 5).collect() == []


def test_bins_are_few():
    rng = np.random.default_rng(1)
    for _ in range(5):
        counts = Counter(np.minimum(rng.geometric(1 / 500, 3000), 2048).tolist())
        bins = packing.plan_bins(counts, 2048)
        placed = Counter()
        for lengths, n in bins:
            assert sum(lengths) <= 2048 and n > 0
            for x in lengths:
                placed[x] += n
        assert placed == counts
        assert sum(n for _, n in bins) <= 1.02 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_packing(table, empty):
    t, rows = tokenizer("byte_bpe_50k.json"), packing.pack_documents(table, RANKS, PATTERN, 0, 64, with_ids=True).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for name, own in by.items():
        own.sort(key=lambda r: r.piece)
        ids = t.encode("null id" if name is None else TEXTS[name] or "", add_special_tokens=False).ids + [0]
        assert b"".join(bytes(r.ids) for r in own) == u32(ids) and all(r.length == 64 for r in own[1:])
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(empty, RANKS, PATTERN, 0).collect() == []


def test_warc(spark, tmp_path):
    rows = [(i, f"u{i % 7}", None if i % 13 == 0 else ["a", "bb", "", "long é " * 50, f"x{i % 40}"][i % 5]) for i in range(120)] + [(5, "u", "dup"), (5, "u", "dup"), (3, None, "dup")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = f"file://{tmp_path}/w"
    warc.write_warc(df, out, roll_bytes=3000)
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.read_warc(spark, out).collect())
    first, seen, expected = {}, set(), []
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 999), i)
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        d, f = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), first[h or ""]
        expected.append((i, d, "response", -1) if f == i and (i, h or "") not in seen else (i, d, "revisit", f or -1))
        seen.add((i, h or ""))
    assert got == sorted(expected)
    warc.write_warc(df.limit(0), f"{out}-e")
    assert warc.read_warc(spark, f"{out}-e").collect() == []


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet' order by 1").fetchall()
    held = [(got.loc[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert sum(p and t for p, t in held) > 0.6 * sum(t for _, t in held)


def test_toxicity_edges(spark, table, empty):
    model = toxicity.train([], [], 0.1)
    assert {round(r.score, 3) for r in toxicity.score_documents(table, model).collect()} == {0.1}
    assert toxicity.score_documents(empty, model).collect() == [] and toxicity.without_toxic(table, model).count() == len(TEXTS) + 1


def j_p(x, y):
    sx, sy = sum(x.values()), sum(y.values())
    return sum(1 / sum(max(x[j] / sx / (x[i] / sx), y[j] / sy / (y[i] / sy)) for j in x | y) for i in x if i in y)


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = (Counter(rng.integers(1, 400, 300).tolist()) for _ in "ab")
        pair = [tuple(np.array(z) for z in zip(*sorted(x.items()), strict=True)) for x in (a, b)]
        exact = near_dup.probability_jaccard(*pair)
        assert exact == pytest.approx(j_p(a, b))
        keys = np.concatenate([near_dup.mix(p[0].astype(np.uint64)) >> np.uint64(20) for p in pair])
        s = near_dup.prob_minhash(keys, np.concatenate([p[1] for p in pair]).astype(float), np.array([len(p[0]) for p in pair]), 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


def test_near_duplicates(spark, table, empty, tmp_path):
    rng = np.random.default_rng(5)
    words, texts = [f"w{i}" for i in range(500)], []
    for _ in range(12):
        base = rng.choice(words, 200)
        for k in range(30 if not texts else 3):
            other = base.copy()
            other[rng.integers(0, 200, k % 6)] = "new"
            texts.append(" ".join(other))
    path = f"{tmp_path}/d.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.read.parquet(path)).collect()}
    sets = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a].keys() & sets[b].keys() and j_p(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    assert got == dict(enumerate(label))
    classes = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()}
    assert classes[0] == classes[1] == 0 and classes[16] == 15 and len(classes) == len(TEXTS) + 1
    assert near_dup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("few", [4096, 3])
def test_suffix_dedup(spark, empty, tmp_path, monkeypatch, few):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    r = np.random.default_rng(0)
    parts = ["".join(r.choice(list("abcé "), size=int(r.integers(20, 160)))) for _ in range(15)]
    texts = ["".join(parts[int(r.integers(15))] if r.random() < 0.6 else "".join(r.choice(list("abé"), size=int(r.integers(1, 70)))) for _ in range(int(r.integers(0, 6)))) for _ in range(150)]
    texts += ["a" * k for k in (49, 50, 51, 300)] + ["ab" * 100, "ba" * 90, "", None]
    path = f"{tmp_path}/d.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(path)
    df, first = spark.read.parquet(path), {}
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(df).collect()}
    cut = {x.doc_id: x.text for x in suffix_dedup.without_repeats(df).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (gone.sum(), runs, hashlib.sha256(kept).hexdigest())
        # A character goes if all its bytes do.
        ends = [len((t or "")[:k].encode()) for k in range(len(t or "") + 1)]
        assert (cut[i] or "") == "".join(c for c, p, q in zip(t or "", ends, ends[1:], strict=False) if not gone[p:q].all())
    assert suffix_dedup.suffix_dedup(empty).collect() == []


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(tuple(r[c] for c in names) for r in queries.queries()[name](spark, sf).collect()) == sorted(expected.fetchall())


def without_seen(rows):
    """Plain version of the removal of strings of 50 bytes that a smaller id has; characters go whole."""
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], 2**63), -1 if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < (-1 if i is None else i):
                gone[p : p + 50] = True
        ends = [len((t or "")[:k].encode()) for k in range(len(t or "") + 1)]
        out.append((i, None if t is None else "".join(c for c, p, q in zip(t, ends, ends[1:], strict=False) if not gone[p:q].all())))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage on nulls, empties, repeated rows, copies, near copies, passages and toxic texts."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words, passage = [f"w{i}" for i in range(600)], "a passage of more than fifty bytes that several documents é share"
    rows = [(i, " ".join(rng.choice(words, 40)) + (f" vile{i % 3} filth" if i % 5 == 0 else "")) for i in range(120)]
    rows += [(200 + i, rows[i + 1][1]) for i in range(5)] + [(300 + i, rows[i + 11][1] + " more") for i in range(5)]
    rows += [(400 + i, " ".join(rng.choice(words, 20)) + " " + passage + f" {i}") for i in range(4)]
    rows += [(500, None), (501, ""), (None, "without id"), (None, "without id"), (None, None), (7, rows[7][1]), (7, "another text of the same id"), (502, "w " * 3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)] + [(None, 1), (3, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = lambda t: float(model.scores(*next(iter(toxicity.features(pa.array([t], pa.string())))))[0])
    kept = [r for r in rows if score(r[1]) < 0.3]
    assert {r[0] for r in rows if r not in kept} >= {i for i in range(0, 120, 5) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sum(r not in kept for r in rows) < 40
    best = {}
    for i, t in kept:
        best[t or ""] = max(best.get(t or "", (-2, None)), (-1 if i is None else i, t or ""))
    kept = [(None if i < 0 else i, t) for i, t in best.values()]
    sets = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in (t.split() for _, t in kept)]
    label = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            linked = kept[a][0] is not None and kept[b][0] is not None and sets[a].keys() & sets[b].keys() and j_p(sets[a], sets[b]) >= 0.8
            if linked and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    kept = [kept[k] for k in range(len(kept)) if kept[k][0] is None or kept[k][0] == min(kept[j][0] for j in range(len(kept)) if label[j] == label[k] and kept[j][0] is not None)]
    kept = without_seen(kept)
    assert any("of more than" in t for _, t in kept) and sum(passage in t for _, t in kept) == 1

    t, got = tokenizer("byte_bpe_50k.json"), corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [(i, t.encode(x, add_special_tokens=False).ids + [0]) for i, x in kept]
    want = Counter((i, k, s, zlib.crc32(u32(own[s:e]))) for i, own in ids for cuts in [[0, *range(len(own) % 2048 or 2048, len(own), 2048), len(own)]] for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(len(x) for _, x in ids) // 2048) + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_corrected_risk_and_its_slopes():
    rng = np.random.default_rng(0)
    branches = set()
    for shift in (-6.0, 0.0, 3.0):
        margins, n, prior = np.concatenate([rng.normal(2, 1, 20), rng.normal(shift, 1, 50)]), 20, 0.4

        def risks(m):
            negative = np.log1p(np.exp(m))
            return prior * np.log1p(np.exp(-m[:n])).mean(), negative[n:].mean() - prior * negative[:n].mean()

        risk, slope = toxicity.risk_slopes(margins, n, prior)
        assert risk == pytest.approx(risks(margins)[1])
        goal = (lambda m: -risks(m)[1]) if risk < 0 else (lambda m: sum(risks(m)))  # noqa: B023
        numeric = [(goal(margins + 1e-5 * (np.arange(70) == k)) - goal(margins - 1e-5 * (np.arange(70) == k))) / 2e-5 for k in range(70)]
        assert slope == pytest.approx(numeric, abs=1e-7)
        branches.add(risk < 0)
    assert branches == {True, False}


def test_toxicity_learns_from_nothing(spark, table, empty):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.learn(empty, labels).weights.any() == toxicity.learn(table, labels).weights.any() == False  # noqa: E712
    odd = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 1), (99, 0)], "doc_id bigint, toxic int")
    assert 0 <= toxicity.learn(table.unionAll(table), odd).scores(np.zeros(0, np.int32), np.zeros(1, np.int64))[0] <= 1


@pytest.mark.parametrize("counts, best", [({500: 400, 524: 400}, 200), ({700: 30, 674: 60}, 30), ({1: 5000, 2047: 10}, 13), ({2048: 3}, 3), ({}, 0)])
def test_bins_that_fill_up(counts, best):
    plan = packing.plan_bins(counts, 2048)
    placed = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        placed.update({x: lengths.count(x) * n for x in set(lengths)})
    assert placed == Counter(counts) and sum(n for _, n in plan) == best


def test_perfect_fillings_are_nearly_found():
    rng, over = np.random.default_rng(6), []
    for _ in range(10):
        bins = [np.diff([0, *sorted(rng.choice(np.arange(1, 2048), rng.integers(2, 9), replace=False)), 2048]) for _ in range(60)]
        counts = Counter(int(x) for b in bins for x in b)
        over.append(sum(n for _, n in packing.plan_bins(counts, 2048)) - 60)
    assert max(over) <= 2


def test_state_goes_on_from_call_to_call(spark, tmp_path):
    """The second call digests the new file alone; verdicts are those of one call over all."""
    path, state = f"{tmp_path}/d.parquet", f"file://{tmp_path}/state"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    verdicts = lambda df: sorted(tuple(r) for r in df.collect())
    first = exact_dedup.exact_dedup(spark.read.parquet(path), state_dir=state)
    assert verdicts(first) == verdicts(exact_dedup.exact_dedup(spark.read.parquet(path)))
    before = spark.read.parquet(f"{state}/digests").count()
    spark.createDataFrame([(5, "a"), (0, "c"), (6, "")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
    second = verdicts(exact_dedup.exact_dedup(spark.read.parquet(path), state_dir=state))
    assert second == verdicts(exact_dedup.exact_dedup(spark.read.parquet(path))) and [r[1:4] for r in second if r[0] == 1] == [(5, 3, False)]
    assert spark.read.parquet(f"{state}/digests").count() == before + 3


def test_texts_that_share_a_digest(spark, tmp_path, monkeypatch):
    """With a digest of the first letter alone, the full texts decide; groups larger than a salt's too."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 3)
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.hex(exact_dedup.F.substring(c, 1, 1)))
    rows = [(i, f"x{i % 3}") for i in range(20)] + [(30, "y"), (31, "y"), (None, "x1")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/d.parquet")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/d.parquet")).collect()}
    assert got == {i: (max(j for j, u in rows if u == t and j is not None), sum(u == t for _, u in rows)) for i, t in rows}


def test_chunk_tables_forget_and_stay_right():
    from cadenza.llm import chunks

    t, rng = tokenizer("word_bpe_49k.json"), np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)] + ["z" * 3000]
    for limits in ((50, 10**6), (10**6, 2000)):
        table = chunks.ChunkTable(chunks.word_table(P.path("word_bpe_49k.json")).encode_many, *limits)
        for _ in range(12):
            texts = [" ".join(rng.choice(words, 30)) for _ in range(5)]
            got = [ids[i:j].tolist() for _, ids, bounds in chunks.encoded(pa.array(texts), table, chunks.word_chunks) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(table.chunks) <= 50 + 155 or sum(map(len, table.chunks)) <= 2000 + 155 * 3000


def test_long_texts_pass_the_slices(spark, tmp_path, monkeypatch):
    """Texts longer than a slice, and a slice boundary between them, in the tokenizing operators."""
    import sentencepiece

    texts = ["word é " * 300_000, "a" * 500_000 + " b", "x", None, "tail " * 250_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d.parquet")
    df = spark.read.parquet(f"{tmp_path}/d.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ours = {r.doc_id: r.ids for r in pieces.encode_texts(df, P.path("piece_bpe_32k.model"), ["ids"]).collect()}
    assert all(ours[i] == sp.encode(t or "", add_bos=True, add_eos=True) for i, t in enumerate(texts) if i != 1)
    token_files.write_token_files(df, f"file://{tmp_path}/t", P.path("word_bpe_49k.json"), 2)
    t = tokenizer("word_bpe_49k.json")
    assert {r.doc_id: bytes(r.ids) for r in token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()} == {i: u32(t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in enumerate(texts)}


def test_token_files_refuse_what_they_cannot_hold(spark, table, tmp_path):
    with pytest.raises(Exception, match="needs more than 1 bytes"):
        token_files.write_token_files(table, f"file://{tmp_path}/a", P.path("word_bpe_49k.json"), 2, bytes_an_id=1)
    out = f"file://{tmp_path}/b"
    token_files.write_token_files(table, out, P.path("word_bpe_49k.json"), 2, n_samples=1)
    (tmp_path / "b/dictionary").write_bytes(b"another")
    with pytest.raises(Exception, match="not the one"):
        token_files.read_token_files(spark, out).collect()


def test_bucket_pointers_name_equal_strings():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice([97, 98], int(n)).tolist()) + b"ab" * 30 for n in rng.integers(0, 90, 30)] + [b"", b"a" * 200]
    raw, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    apart = np.zeros(len(raw), np.int64)
    pointer = suffix_dedup.bucket_pointers(raw, bounds, apart)
    named = {}
    for t, a in zip(texts, bounds, strict=False):
        for p in range(len(t) - 49):
            named.setdefault(t[p : p + 50], set()).add(int(pointer[a + p]))
    assert all(len(x) == 1 for x in named.values()) and len({x for v in named.values() for x in v}) == len(named)


def test_other_columns_may_clash(spark, tmp_path):
    rows = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "é " * 40_000, "y", 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, place int")
    got = chat.conversation_digests(chat.write_conversations(chat.format_conversations(df, RANKS, PATTERN)), RANKS, PATTERN).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(2, 80_000)]
    pages = spark.createDataFrame([(i, f"u{i}", "h" * (200_000 if i == 2 else i % 2), "z", 5) for i in range(6)], "page_id bigint, url string, html string, digest string, shard int")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    assert Counter(r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()) == {"response": 3, "revisit": 3}
    vectors = spark.createDataFrame([(1, [1.0, -1.0], 3, 4), (2, None, 3, 4), (3, [1.0], 3, 4), (None, [1.0, None], 3, 4)], "id bigint, v array<double>, code int, block int")
    codes = hamming.sign_codes(vectors, "id", "v", 2)
    assert sorted((r.id or 0, r.code) for r in codes.collect()) == [(0, 1), (1, 1), (3, 1)] and hamming.top_k(codes, codes, 5).count() == 2


def test_arrow_slices_keep_their_place():
    texts = pa.array(["x y", None, "z"]).slice(1)
    assert [len(c) for _, c in toxicity.features(texts)] == [2]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Repeated rows, ids with several texts and null ids, in two files; passages of 60 bytes and near copies."""
    words = [f"w{i}" for i in range(400)]
    near, passage = " ".join(words[:200]), "".join(chr(97 + i * 7 % 26) + str(i % 10) for i in range(30))
    rows = [(5, "A"), (9, "A"), (5, "B"), (9, "A"), (None, "C"), (None, "C"), (None, "D"), (7, "D"), (None, "A"), (5, "A")]
    rows += [(20, near), (20, " ".join(words[200:])), (21, near + " more"), (21, near + " more"), (22, " ".join(words[200:]) + " more"), (20, near)]
    rows += [(30, f"x{passage}y"), (31, f"left {passage} right"), (31, f"left {passage} right"), (31, f"other {passage}"), (31, "whole")]
    folder = str(tmp_path_factory.mktemp("r") / "documents.parquet")
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder), rows


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_dedup_of_repeated_rows(repeated):
    docs, rows = repeated
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert pairs(exact_dedup.keep_one_of_each(docs)) == Counter((None if i < 0 else i, t) for t, i in best.items())


def test_near_dedup_of_repeated_rows(repeated):
    docs, rows = repeated
    # Classes by hand: equal texts, and each of the two long texts with its copy that has a word more.
    base = [(i, t, t.removesuffix(" more")) for i, t in rows]
    least = {}
    for i, t, b in base:
        if i is not None and (b not in least or i < least[b][0]):
            least[b] = (i, t)
    assert pairs(near_dup.keep_one_of_each_class(docs)) == Counter(least.values()) + Counter((i, t) for i, t, _ in base if i is None)
    sizes = Counter(b for i, _, b in base if i is not None)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_dup.near_duplicates(docs).collect())
    assert got == Counter((i, None, 1) if i is None else (i, least[b][0], sizes[b]) for i, _, b in base)


def test_suffix_dedup_of_repeated_rows(repeated):
    docs, rows = repeated
    seen = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            seen.setdefault(t[p : p + 50], set()).add(-1 if i is None else i)
    expected = []
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if min(seen[t[p : p + 50]]) < (-1 if i is None else i):
                gone[p : p + 50] = [True] * 50
        expected.append((i, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    assert (31, "left  right") in expected
    assert pairs(suffix_dedup.without_repeats(docs)) == Counter(expected)


def test_toxicity_and_packing_of_repeated_rows(repeated):
    docs, rows = repeated
    assert pairs(toxicity.without_toxic(docs, toxicity.train([], [], 0.1))) == Counter(rows)
    packed = packing.pack_documents(docs, RANKS, PATTERN, end_id=0).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in rows)


def test_added_tokens_as_the_library_does_by_default():
    from tokenizers import Tokenizer

    from cadenza.llm import chunks

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "é  <|endoftext|>\x1cz", "A <|ENDOFTEXT|> <|endoftext|><|endoftext|>  c", " <|endoftext|> ", "<|endoftext |> plain", "it's\n<|endoftext|>\n\nend "] + [t or "" for t in TEXTS]
    byte_added = chunks.added_tokens(P.path("byte_bpe_50k.json"))
    for name, table, split in (("word_bpe_49k.json", chunks.word_table(P.path("word_bpe_49k.json")), chunks.word_chunks), ("byte_bpe_50k.json", chunks.byte_table(RANKS, PATTERN, added=byte_added), chunks.space_chunks)):
        t = Tokenizer.from_file(P.path(name))
        got = [ids[i:j].tolist() for _, ids, bounds in chunks.encoded(pa.array(texts), table, split) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_dictionary_samples_are_bounded_by_parameter(table, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(token_files.zstandard, "train_dictionary", lambda size, samples: seen.append(samples) or (_ for _ in ()).throw(ValueError()))
    for n in (6, 1 << 20):
        token_files.write_token_files(table, f"file://{tmp_path}/{n}", P.path("word_bpe_49k.json"), 2, sample_bytes=n)
    assert max(map(len, seen[0])) == 6 and max(map(len, seen[1])) > 1000


def test_plain_words_need_no_fences():
    marks = ["", ".", ",", "...", "!?", ";:,", "'s", "1", "-", ".a", "é", "ı", "K"]
    words = ["a", "And", "REND", "ve", "s", "notaword", "x" * 300]
    found = [w + m for w in words for m in marks] + ["", ",", "<|endoftext|>,", "<|endoftext|>"] + [f"w{chr(97 + k % 26) * (k % 40)}q{chr(97 + k // 26 % 26)}{'.' * (k % 3)}" for k in range(5000)]
    ids, lengths = chunks.word_table(P.path("word_bpe_49k.json")).encode_many(found)
    got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [x.ids for x in tokenizer("word_bpe_49k.json").encode_batch(found, add_special_tokens=False)]


def test_solid_chunks_are_encoded_together_as_alone():
    """Joined chunks' ids against the library's for each whole text: white space of all kinds, added tokens, fences, wide characters."""
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    table = chunks.byte_table(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, added=chunks.added_tokens(P.path("byte_bpe_50k.json")))
    rng = random.Random(5)
    parts = ["don't", "a", "Ünïcode", "日本語", "x" * 300, "<|endoftext|>", "<|end", "oftext|>", "\ue000", "e\u0301", "\U0001f600\u200d", "\u180e", "12,345", "--", "\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", " ", "  ", ""]
    texts = ["", " ", *parts, *("".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(2000))]
    found = [ids[a:b].tolist() for _, ids, bounds in chunks.encoded(pa.array(texts), table, chunks.space_chunks) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_plain_words_of_any_latin_letters_and_marks():
    """Every letter and mark of a plain chunk, in words and behind them, against the library's ids."""
    import random
    import string

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    table = chunks.word_table(P.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x250) if chunks.PLAIN.fullmatch(chr(c))]
    marks = [x for x in string.punctuation if x != "'"]
    assert set(string.ascii_letters) < set(letters) and all(x.isalpha() for x in letters) and all(chunks.PLAIN.fullmatch("a" + x) for x in marks)
    rng = random.Random(9)
    words = [*letters, *("a" + x for x in marks), *("É" + x for x in letters)]
    words += ["".join(rng.choices(letters, k=rng.randrange(1, 12))) + "".join(rng.choices(marks, k=rng.randrange(4))) for _ in range(20000)]
    words += ["Aª", "ª", "µm", "İx", "ﬁn", "x'll", "a'", "<|endoftext|>", "a<|endoftext|>", "a<|endoftext|>b"]
    found = [ids[a:b].tolist() for _, ids, bounds in chunks.encoded(pa.array(words), table, chunks.word_chunks) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [whole.encode(x, add_special_tokens=False).ids for x in words]
