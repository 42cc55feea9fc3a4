"""Whitening, conversation tries, SentencePiece: against brute force and the library, on the tables and on awkward rows."""

import array
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelry.llm import bpe, prefixes, queries, sentences, shared, tries, whitening

PIECES = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [None, "", " ", "\n", "a  b", "   lead", "trail  ", "x\n y", "▁▁a▁ b", "日本語 の テキスト 梦", "🙂 🙂🙂", "x" * 3000, "ab " * 2000, " " * 70 + "z", "<s> </s> <0x0A> <unk>", "\x00\x1c", "é ﬁ", "===== ---- 0000"]
DOCS = "doc_id long, text string, lang string, ids int, decoded string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def packed(ids):
    return array.array("I", ids).tobytes()


def test_sentences_of_the_table(spark, small, library):
    want = Counter()
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        want[d["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_prefix_sentencepiece(spark, small).collect()) == want


def test_sentences_of_awkward_rows(spark, library):
    rows = [(i, t, "en", 1, "x", "y") for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None, None)], DOCS)
    coded = sentences.encode_sentences(docs, PIECES, decode=True)
    want = Counter()
    for d in docs.collect():
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        want[d["doc_id"], packed(ids), library.decode(ids).encode()] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in coded.collect()) == want
    again = sentences.decode_sentences(coded.select("doc_id", "ids"), PIECES)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in again.collect()) == want
    assert sentences.encode_sentences(docs.limit(0), PIECES).collect() == []


@given(st.text(alphabet=st.sampled_from("ab theE1 \n\t 'sé日\x1c.,!🙂▁="), max_size=40) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_sentences_of_any_text(text):
    encoder = sentences.sentence_encoder(PIECES)
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.library.encode(text, add_bos=True, add_eos=True)
    assert encoder.encode(text) == packed(ids)
    assert encoder.decode(ids).decode() == encoder.library.decode(ids)


@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300) | st.sampled_from([1, 2, 259, 29871]), max_size=12))
@settings(max_examples=400, deadline=None)
def test_any_ids_decode_as_in_the_library(ids):
    encoder = sentences.sentence_encoder(PIECES)
    assert encoder.decode(ids).decode() == encoder.library.decode(ids)


@given(st.dictionaries(st.text("abc", min_size=2, max_size=5), st.integers(0, 6), max_size=14), st.text("abcd", max_size=14))
@settings(max_examples=600, deadline=None)
def test_prefixes_follow_the_definition_under_any_merges(order, text):
    """Whatever the order of merges: ties, unions before their halves, unreachable tokens, unknown characters."""
    names = [*order, "a", "b"]
    table = prefixes.PrefixTable({t: i for i, t in enumerate(names)}, order | {"a": 99, "b": 99})
    ids = table.tokens_of(table.extend([], text))
    assert [table.text(i) for i in ids] == table.merged(text)


def test_edits_read_only_their_surroundings():
    encoder, rng = bpe.prefix_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(2)
    data = b" ".join(rng.choice([b"the", b"retion", b"ouent", b"hello", b"1234"]) for _ in range(40_000))
    last, seen = encoder.extend([], data), []
    table, extend = encoder.table, encoder.table.extend
    table.extend = lambda done, text, stop=None: (seen.append(len(text)), extend(done, text, stop))[1]
    try:
        edited = encoder.edit(last, data, 100_000, 100_004, b"xyz")
        appended = encoder.append(last, data, b"tail")
    finally:
        del table.extend
    assert sum(seen) < 40 * encoder.longest < len(data) / 10
    assert edited == encoder.extend([], data[:100_000] + b"xyz" + data[100_004:]) and appended == encoder.extend([], data + b"tail")


def check_whitening(rows, vectors, components=4):
    """``vectors``: (key, entries) of the rows that take part; all sums in whole numbers and fractions."""
    grid = [(k, tuple(math.floor(256 * float(c)) for c in v)) for k, v in vectors]
    fit = sorted({x for _, x in grid})
    n, d = len(fit), len(fit[0])
    sums = [sum(column) for column in zip(*fit)]
    centred = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    v = np.array([[float(Fraction(sum(y[i] * y[j] for y in centred), n**3)) for j in range(d)] for i in range(d)])
    values, trace = np.sort(np.linalg.eigvalsh(v))[::-1], float(np.trace(v))
    by_key = dict(grid)
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in rows) == Counter((k, c, n, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x in grid for c in range(1, min(components, d) + 1))
    lines = defaultdict(dict)
    for r in rows:
        e = values[r["component"] - 1]
        assert r["explained"] == pytest.approx(e / trace, rel=1e-6, abs=1e-13) and r["identity_error"] <= 1e-8
        lines[by_key[r["vec_id"]]][r["component"] - 1] = r["whitened"]
    live = [k for k in range(min(components, d)) if values[k] > 1e-12 * values[0]]
    assert set(lines) == set(fit) and all((lines[x][k] is None) == (k not in live) for x in fit for k in range(min(components, d)))
    w, y = np.array([[lines[x][k] for k in live] for x in fit]), np.array([[float(Fraction(c, n)) for c in row] for row in centred])
    assert np.abs(w.T @ w / n - np.eye(len(live))).max() < 1e-8
    found = np.linalg.lstsq(y, w, rcond=1e-12)[0]  # whitened values are y times eigenvectors over the roots of the eigenvalues
    assert np.abs(y @ found - w).max() < 1e-8
    for at, k in enumerate(live):
        u = (y.T @ w[:, at]) / n / math.sqrt(values[k])
        assert np.linalg.norm(u) == pytest.approx(1) and np.abs(v @ u - values[k] * u).max() < 1e-8 * values[0]


def test_whitening_of_the_table(spark, data):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_whitening(queries.op11_polarised_whitening(spark, data).collect(), vectors)


VECTORS = "vec_id long, embedding array<float>, x string, n int, component string"


def test_whitening_of_awkward_rows(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1 + k) + 100 * k for k in range(5)], "a", 1, "b") for i in range(40)]
    good += [good[0], good[0], (91, good[1][1], None, None, None), (92, [0.0] * 5, None, None, None), (None, good[2][1], None, None, None), (None, good[3][1], None, None, None)]
    bad = [(50, None), (51, []), (52, [1.0] * 4), (53, [1.0, None, 1.0, 1.0, 1.0]), (54, [float("nan")] * 5), (55, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame([*good, *((k, v, None, None, None) for k, v in bad)], VECTORS)
    out = whitening.whiten(rows).collect()
    assert Counter(r["vec_id"] for r in out) == Counter({k: 4 * c for k, c in Counter(g[0] for g in good).items()})
    kept = [r[:2] for r in rows.where("vec_id is not null and vec_id not in (50, 51, 52, 53, 54, 55)").collect()]
    check_whitening([r for r in out if r["vec_id"] is not None], kept)
    assert whitening.whiten(rows.where("vec_id between 50 and 51")).collect() == [] and whitening.whiten(rows.limit(0)).collect() == []
    same = whitening.whiten(rows.where("vec_id = 0")).collect()
    assert len(same) == 12 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    check_whitening(whitening.whiten(rows.where("vec_id < 3").distinct()).collect(), [g[:2] for g in rows.where("vec_id < 3").distinct().collect()])


def test_whitening_is_exact_whatever_the_size_of_entries(spark):
    rng = random.Random(2)
    for scale in (1e-3, 3e5, 2e12):
        rows = spark.createDataFrame([(i, [rng.uniform(-scale, scale), rng.gauss(0, scale), 1e13]) for i in range(60)], "vec_id long, embedding array<double>")
        check_whitening(whitening.whiten(rows).collect(), [tuple(r) for r in rows.collect()])


@given(st.lists(st.lists(st.integers(-(1 << 62), 1 << 62) | st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_polarisation_recovers_covariances(fit):
    n, x = len(fit), np.array(fit, dtype=np.int64)
    sums = [sum(column) for column in zip(*fit)]
    centre = [whitening.round_half(s, n) for s in sums]
    if max(abs(a - m) for row in fit for a, m in zip(row, centre)) >= 1 << 62:
        return
    v = whitening.covariance(n, sums, whitening.pair_squares(x, np.array(centre, dtype=np.int64)))
    for i in range(3):
        for j in range(3):
            assert v[i, j] == float(Fraction(sum((n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in fit), n**3))


def plain_trie(rows):
    """All nodes by brute force: (conv_id, depth, parent, members, children, leaves, saved, hash of ends)."""
    turns = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[conv].append((role or "", text or ""))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    children, leaves, saved, = Counter(), Counter(), Counter()
    for prefix, members in nodes.items():
        children[prefix[:-1]] += bool(prefix)
    for prefix, members in nodes.items():
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children[prefix]
            saved[prefix[:d]] += (len(members) - 1) * len(prefix[-1][1]) if prefix else 0
    out = Counter()
    for prefix, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(prefix))
        out[min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), children[prefix], leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return Counter(tuple(r[c] for c in NODE) for r in df.collect())


def test_trie_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(queries.op12_prefix_trie(spark, data)) == plain_trie(rows)


TURNS = "conv_id long, turn long, role string, text string, depth string, part int, rep long"


def test_trie_of_awkward_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 12), 100, 101, 140, 205, 206, 207, -3, -105, 3000, 1_000_000_007]:
        for turn in range(rng.choice([1, 2, 5, 7, 23])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", None, ""]), rng.choice(["a", "日本", None, "", "b,1"])))
    rows += rows[:5]
    long_ = [(c, turn, "user", f"t{turn % 7}" if turn < (60 if c % 2 else 75) else f"c{c} {turn}") for c in (100_000, 100_001, 100_002, 100_003, 100_004) for turn in range(90 + c % 5)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in [*rows, *long_]] + [(None, 1, "user", "gone", None, None, None)], TURNS)
    want = plain_trie([*rows, *long_])
    monkeypatch.setattr(shared, "LEAST_HOT", 20)
    monkeypatch.setattr(tries, "IDS_AT_ONCE", 4)
    for band in (32, 4, 2):
        assert nodes_of(tries.conversation_trie(df, band)) == want
    assert tries.conversation_trie(df.limit(0)).collect() == [] and tries.conversation_trie(df.where("conv_id is null")).collect() == []


def test_copies_share_one_path_and_long_conversations_are_spread(spark):
    copies = [(c, turn, "user", "same " * turn) for c in range(7000, 9500) for turn in range(3)]
    long_ = [(55, turn, "user", f"text {turn}") for turn in range(250)]
    df = spark.createDataFrame([*copies, *long_], "conv_id long, turn long, role string, text string")
    assert nodes_of(tries.conversation_trie(df)) == plain_trie([*copies, *long_])


def test_salted_join_keeps_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_HOT", 10)
    many = shared.written(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) as k"), "many")
    one = shared.written(spark.range(40).selectExpr("id as k", "id * 2 as v"), "one")
    assert Counter(map(tuple, shared.salted_join(many, one, ["k"]).select("id", "k", "v").collect())) == Counter(map(tuple, many.join(one, "k").select("id", "k", "v").collect()))
