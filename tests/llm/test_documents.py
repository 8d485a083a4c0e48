"""Each operator on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from sluice.llm import fingerprints, groups, language, lines, near, packing, pieces, sharding, suffixes  # noqa: E402
from sluice.llm.common import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, chunk int, bucket string, digest binary, line string"
R = random.Random(4)
WORDS = ["".join(R.choice("abcdeéß") for _ in range(R.randint(2, 7))) for _ in range(200)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n))


LONG = prose(6000, 1)
BASE = prose(300, 2)
SHARED = prose(40, 3)
TEXTS = [
    BASE, None, "", " \n\t ", "x", "two words", BASE, BASE.replace(" ", "  ", 3), BASE[:900] + "changed here" + BASE[915:], LONG, LONG[:20000] + "tail " + LONG[20000:],
    prose(50, 5) + SHARED + prose(50, 6), prose(60, 7) + SHARED + prose(10, 8), SHARED, BASE.upper(), "日本語のテキスト。" * 30, "日本語のテキスト。" * 30 + "終", "a" * 500, "a" * 700, "\x00 ́é ﬁ 🙂 İΣ <|endoftext|> ▁▁ <s>",
    *[BASE + f" {i}" for i in range(12)], *[prose(80, 100 + i) for i in range(15)],
]
ROWS = [(i, t, "xx", "s", 0, 7, "n", 1, "b", b"d", "l") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, and rows without an id."""
    return spark.createDataFrame([ROWS[0], ROWS[0], (None, BASE, *ROWS[0][2:]), (None, None, *ROWS[0][2:]), (3, prose(90, 77), *ROWS[0][2:])], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_sharding(docs, odd, empty):
    rows = sharding.shard_documents(docs, rows_per_block=4).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sorted(x.slot for x in sharding.shard_documents(odd, 1).collect()) == list(range(5))
    assert sharding.shard_documents(empty).collect() == []


def test_ring_moves_little():
    tokens = sharding.ring_tokens(8, 64)
    more = sharding.ring_tokens(9, 64)
    assert set(tokens) <= set(more)
    owners = [s for _, s in tokens]
    demand = [R.randint(0, 50) for _ in owners]
    total = sum(demand)
    dealt = sharding.walk_ring(owners, demand, sharding.capacities(total, 8, 1.25))
    moved = sum(b - a for arc, parts in enumerate(dealt) for a, b, shard, _ in parts if shard != owners[arc])
    assert [sum(b - a for a, b, *_ in p) for p in dealt] == demand
    assert moved < 0.2 * total
    assert max(sum(b - a for p in dealt for a, b, s, _ in p if s == shard) for shard in range(8)) <= -(-1.25 * total // 8)


def test_pieces(docs, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = by_id(pieces.digest_documents(docs, path))
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == want
    own, r = pieces.Pieces.load(path), random.Random(9)
    bits = [" ", "  ", "\n", "▁", "a", "th", "the", "é", "①", "ing", "🙂", "0", "--", "    ", "中", "\x00", "ab", "​", "__"]
    for _ in range(2000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert own.encode(t) == model.encode(t)
        assert own.decode(own.encode(t)) == model.decode(model.encode(t))
    assert pieces.encode_documents(odd, path).count() == 5
    assert pieces.encode_documents(empty, path).collect() == []


def plain_form(t):
    import unicodedata

    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def expected_fingerprints(rows):
    """Every column of every row, in the stated order: by falling id, rows without one last, then by the text's hash."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), 42 if r[1] is None else xx(r[1])))
    out = []
    for at, (i, t) in enumerate(rows):
        t, following = t or "", rows[(at + 1) % len(rows)][1] or ""
        changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        prints = []
        for x in (t, changed):
            raw = plain_form(x).encode()
            prints.append(f"{xxhash.xxh3_128_hexdigest(raw)}-{len(raw):x}")
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), *prints, float(plain_form(t) == plain_form(changed)), float(plain_form(t) == plain_form(following))))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 2, 4, 50])
def test_fingerprints(spark, docs, empty, ranges):
    odd = [(5, "same " * 40), (5, "same " * 40), (5, "same " * 40), (5, "Same  " * 40), (None, "x"), (None, None), (None, ""), (None, "x"), (-3, "a\u0301b" * 9), (2**63 - 1, "top"), (-(2**63), "low")]
    for rows in (list(enumerate(TEXTS)), odd, [(1, "lone text")], [(1, "twice"), (1, "twice")], odd + list(enumerate(TEXTS))):
        df = spark.createDataFrame([(d, t, "", "", 0, 0, "", 0, "", b"", "") for d, t in rows], SCHEMA).repartition(3)
        df.cache().count()
        found = fingerprints.fingerprints(df, ranges=ranges).collect()
        assert sorted((tuple(r) for r in found), key=str) == expected_fingerprints(rows)
    assert fingerprints.fingerprints(empty, ranges=ranges).collect() == []


def test_fingerprints_part_equal_digests(docs, monkeypatch, spark):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(fingerprints)
    monkeypatch.setattr(fingerprints, "digest", lambda form: "same")
    try:
        found = by_id(fingerprints.fingerprints(docs.where("doc_id in (0, 6, 9)"), ranges=1))
    finally:
        cloudpickle.unregister_pickle_by_value(fingerprints)
    assert found[0].fingerprint == found[6].fingerprint != found[9].fingerprint


def reachable(n, linked):
    low = list(range(n))
    for _ in range(n):
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_duplicates(docs, odd, empty):
    def words_of(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = []
    for t in TEXTS:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = reachable(len(sets), linked)
    for limits in ({}, {"max_node": 4, "levels": 2, "max_ids": 3}, {"max_weight": 300}):
        found = by_id(near.near_duplicates(docs, **limits))
        assert [(found[i].n_shingles, found[i].component_id, found[i].kept) for i in range(len(sets))] == [(len(s), low[i], low[i] == i) for i, s in enumerate(sets)]
    assert near.near_duplicates(odd).count() == 5
    assert near.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("step", [40, 3000, 1 << 22])
def test_shingles_of_many_texts(monkeypatch, step):
    """However the texts are cut into steps and slices, against plain Python."""
    import pyarrow as pa

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    monkeypatch.setattr(near, "_STEP", step)
    texts = [*TEXTS, "A b", " a  B\tc\n", "b a", "É É\u0085x", *[prose(R.randint(0, 30), i).upper() for i in range(40)]] * 2
    for array in (pa.array(texts, pa.string()), pa.array(["x y z", None, *texts], pa.string()).slice(2)):
        sets = near.shingle_sets(array)
        assert [len(s) for s in sets] == [len(plain(t)) for t in texts]
        for i in range(0, len(texts), 7):
            for j in range(i, len(texts), 5):
                assert len(np.intersect1d(sets[i], sets[j])) == len(plain(texts[i]) & plain(texts[j]))


@pytest.mark.parametrize("step", [50, 5000])
def test_words_encoded_in_steps_and_slices(monkeypatch, step):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "_STEP", step)
    whole = pa.array(["skipped", *TEXTS, *TEXTS], pa.string()).slice(1)
    borders, at = packing._steps(whole), 0
    for a, z in zip(borders, borders[1:], strict=False):
        ids, ends = own.encode(whole.slice(a, z - a), 2)
        for i in range(z - a):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*t.encode(whole[at].as_py() or "", add_special_tokens=False).ids, 2]
            at += 1
    assert at == len(whole)


def test_chosen_paths_reach_their_recall_in_large_nodes(spark):
    """Pairs that agree in each function with the threshold's probability, all nodes large enough to branch at every level."""
    r, rows, n = np.random.default_rng(5), [], 4000
    for i in range(n):
        a, b = r.integers(1, 1 << 62, (2, near.FUNCTIONS))
        same = r.random(near.FUNCTIONS) < near.PERCENT / 100
        b[same] = a[same]
        rows += [(2 * i, 1, a.tolist()), (2 * i + 1, 1, b.tolist())]
    classes = spark.createDataFrame(rows, "id long, weight long, signature array<long>").cache()
    for levels in (1, 2, 3):
        nodes = near.chosen_paths(classes, 0.9999, levels, max_ids=1)
        pairs = nodes.selectExpr("node", "id", "id div 2 as pair").distinct().groupBy("node", "pair").count().where("count = 2")
        assert n - pairs.select("pair").distinct().count() <= 3


def line_key(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ") or ("\0" + line.strip() if line.strip() else "")


def expected_lines(rows):
    """(doc_id, text) -> positions that go, by comparing all pairs of lines."""
    occurrences = {(d, xx(t), i, t, line_key(line)) for d, t in rows if t and d is not None for i, line in enumerate(t.split("\n")) if line_key(line)}
    kinds = sorted({o[4] for o in occurrences})
    codes = [int(h) for h in lines.simhashes([k.encode() for k in kinds])]
    fuzzy = [k for k, x in enumerate(kinds) if not x.startswith("\0")]
    linked = [(a, b) for a in fuzzy for b in fuzzy if b < a and (codes[a] ^ codes[b]).bit_count() <= lines.RADIUS and lines.similar_lines(kinds[a], kinds[b])]
    low, at, seen, gone = reachable(len(kinds), linked), {k: i for i, k in enumerate(kinds)}, {}, {}
    for d, h, i, t, k in sorted(occurrences, key=lambda o: o[:3]):
        if seen.setdefault(low[at[k]], (d, t, i)) != (d, t, i):
            gone.setdefault((d, t), []).append(i)
    return gone


def xx(text):
    """Spark's xxhash64 of a text: the order of rows that share an id."""
    value = int(xxhash.xxh64_intdigest(text.encode(), 42))
    return value - (1 << 64) if value >> 63 else value


def check_lines(df):
    rows = df.select("doc_id", "text").collect()
    gone, found = expected_lines([tuple(r) for r in rows]), lines.dedup_lines(df).collect()
    assert len(found) == len(rows)
    for r, key in zip(sorted(found, key=lambda r: (r.n_chars, str(r.doc_id))), sorted(df.collect(), key=lambda r: (r.n_chars, str(r.doc_id))), strict=True):
        out = gone.get((key.doc_id, key.text), [])
        assert (r.lines_removed or []) == out
        assert r.text == (None if key.text is None else "\n".join(x for i, x in enumerate(key.text.split("\n")) if i not in out))
    return gone


def test_lines(spark, docs, odd, empty):
    def numbered(rows):
        return spark.createDataFrame([(d, t, "xx", "s", i, 7, "n", 1, "b", b"d", "l") for i, (d, t) in enumerate(rows)], SCHEMA)

    assert check_lines(numbered(list(enumerate(TEXTS))))
    extra = [(1, "A line\nmenu\n--"), (5, "a LINE!\nmenu."), (5, "B alone\nmenu\n--"), (5, "B alone\nmenu\n--"), (None, "menu"), (None, "menu"), (7, "menu\n" * 50), (8, ""), (9, None), (2, "\n \n--\n")]
    assert check_lines(numbered(extra)).get((5, "B alone\nmenu\n--")) == [1, 2]
    r, many = random.Random(5), []
    for i in range(150):
        base = [r.choice(WORDS) for _ in range(r.choice([4, 12, 40]))]
        for k in range(r.choice([1, 2, 5])):
            line = list(base)
            line[r.randrange(len(line))] = r.choice(WORDS)
            many.append((3 * i + k, " ".join(line) + "\n" + " ".join(base[:3])))
    assert check_lines(numbered(many).repartition(5))
    found = lines.dedup_lines(docs).where("doc_id = 0").first()
    assert found.node == "n"
    assert lines.dedup_lines(odd).count() == 5
    assert lines.dedup_lines(empty).collect() == []
    assert lines.dedup_lines(docs.withColumnRenamed("lang", "lines_removed").withColumnRenamed("node", "row")).count() == len(TEXTS)


def test_simhash_is_the_majority_of_word_hashes():
    def mixed(word):
        h = (len(word) + sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(word))) % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ h >> shift) * factor % (1 << 64)
        return h

    for n in (1, 2, 3, 7, 64, 700):
        line = b" ".join(str(R.random()).encode() for _ in range(n)) + b" twice twice"
        words = [mixed(w) for w in set(line.split())]
        want = sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))
        assert lines.simhashes([b"x", line, b"y z", b"\0--"])[1] == want


def test_normal_forms():
    texts = ["Aé_É  x\n\n \t\n--\u00a0!\nÀB\u0085c\nII", "İΣ ς_a\n中 文\n***", "\x1cab²½ª\nµ×÷ÿŸ", "a\rb\x0bc\x0c"]
    for text in texts:
        assert lines.normalised(text) == [line_key(line).encode() for line in text.split("\n")]


@pytest.mark.parametrize("n_lines", [10, 10**8, 10**9, 10**11])
def test_layouts_find_the_same_pairs(n_lines):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in r.choice(64, r.integers(0, 10), replace=False)) for _ in range(200)]
    hashes = np.unique(np.array([int(base[i % 40]) ^ f for i, f in enumerate(flips)], np.uint64))
    blocks, dealing = lines.layout(n_lines)
    met = set()
    for mask, masks in lines.choices(blocks, dealing):
        for part in np.unique(hashes & np.uint64(mask)):
            some = np.flatnonzero((hashes & np.uint64(mask)) == part)
            label = lines.connected(hashes[some], masks)
            met |= {(int(some[a]), int(some[b])) for a in range(len(some)) for b in range(a) if label[a] == label[b]}
    near = {(a, b) for a in range(len(hashes)) for b in range(a) if (int(hashes[a]) ^ int(hashes[b])).bit_count() <= lines.RADIUS}
    assert near and near <= met


def test_edited_lines_are_removed(spark, tmp_path):
    """The query, against edit similarity alone: lines with one word replaced. Those beyond the radius are not found."""
    r, rows, pairs = random.Random(12), [], {20: 0, 50: 0}
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    sizes = {}
    for i in range(600):
        n = r.choice([20, 50])
        line = [r.choice(words) for _ in range(n)]
        other = list(line)
        other[r.randrange(n)] = r.choice(words)
        pairs[n] += 1
        sizes[2 * i + 1] = n
        rows += [(2 * i, " ".join(line), *ROWS[0][2:]), (2 * i + 1, " ".join(other), *ROWS[0][2:])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(lines.op1_line_dedup(spark, str(tmp_path)))
    assert all(found[d].n_removed == 0 for d in found if d % 2 == 0)
    share = {n: sum(found[d].n_removed for d in sizes if sizes[d] == n) / pairs[n] for n in pairs}
    print(share)
    assert share[20] >= 0.6 and share[50] >= 0.85


def test_short_lines_are_removed_exactly(spark, tmp_path):
    rows = [(1, "Menu\n\n---\nab\nx", *ROWS[0][2:]), (2, "menu!\n \n--- \nac\n***\n\n", *ROWS[0][2:])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(lines.op1_line_dedup(spark, str(tmp_path)))
    kept = [" ", "ac", "***", "", ""]
    assert (found[1].n_removed, found[2].n_removed) == (0, 2)
    assert found[2].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(R.choice("ab") for _ in range(R.randint(0, 9))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(300):
        s = r.integers(1, 1 + r.integers(1, 5), r.integers(1, 50))
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_bytes": 9000}])
def test_passages(spark, docs, odd, empty, sizes):
    first, want = {}, {}
    for d, t in enumerate(TEXTS):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            if first.setdefault(w, d) < d:
                gone[p : p + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    found = by_id(suffixes.repeated_passages(docs, **sizes))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in found.items()} == want
    again = suffixes.repeated_passages(odd).collect()
    assert len(again) == 5 and all(r.n_removed == 0 for r in again)
    whole = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.kept_sha256) for r in again) == whole
    same_id = spark.createDataFrame([(4, "k" * 30 + BASE[:200], *ROWS[0][2:]), (9, "one " + BASE[:120], *ROWS[0][2:]), (9, "two " + BASE[:160] + " end", *ROWS[0][2:]), (9, "three " + BASE[300:500], *ROWS[0][2:])], SCHEMA)
    rest = sorted((r.n_bytes, r.n_removed) for r in suffixes.repeated_passages(same_id, **sizes).collect())
    sizes_of = [len(x.encode()) for x in ("k" * 30 + BASE[:200], "one " + BASE[:120], "two " + BASE[:160] + " end", "three " + BASE[300:500])]
    assert rest == sorted(zip(sizes_of, [0, len(BASE[:120].encode()), len(BASE[:160].encode()), 0]))
    assert suffixes.repeated_passages(empty).collect() == []


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]
    rows = packing.pack_documents(docs, path, block_docs=7).collect()
    for d, own in enumerate(ids):
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own))
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack_documents(odd, path).select("length").groupBy().sum().first()[0] > 0
    assert packing.pack_documents(empty, path).collect() == []


def test_packing_deals_like_documents_to_one_shard(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(40 * copy + i, prose(60, 700 + i) + f" {copy}", *ROWS[0][2:]) for copy in range(3) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    shards, blocks = {}, 6000
    for r in packing.pack_documents(docs, path, window=512, block_ids=blocks).collect():
        shards.setdefault(r.doc_id % 40, {}).setdefault(r.sequence_id, set()).add(r.doc_id)
    assert sum(any(len(ids) == 3 for ids in s.values()) or len(s) <= 3 for s in shards.values()) >= 32


def test_packing_scores_all_terms_of_a_seed():
    seed, few, other = np.arange(300), np.arange(200, 240), np.arange(400, 440)
    idf = np.concatenate([np.full(200, 3.0), np.full(300, 1.0)])
    assert np.argsort(-packing.Index([seed, other, few], idf, 120.0).scores(0)).tolist() == [0, 2, 1]


def test_packing_prefers_neighbours():
    docs = [(i, np.array([i % 3 * 100 + j for j in range(40)] + [2])) for i in range(30)]
    packer = packing.Packer(np.full(400, 2.0), 41.0, window=123)
    kinds = [{d[0] % 3 for d, _, _ in pieces} for pieces in packer.block(docs)]
    assert sum(len(k) == 1 for k in kinds) >= len(kinds) - 4


def test_language(spark, odd, empty):
    r, rows = random.Random(1), []
    for i in range(240):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, " ".join("".join(r.choice("abcde" if lang == "aa" else "fghij") for _ in range(5)) for _ in range(30)), lang))
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (None, "abcde " * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(docs, per_label=40, pieces=2, epochs=4, hidden=6)
    out = {r.doc_id: r for r in language.predict(docs, net).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert {r.doc_id for r in docs.where(language.held_out(docs.doc_id)).collect()} & set(range(240)) == set(held)
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.train(empty) is None
    assert language.predict(odd, net).count() == 5


def test_gradients():
    net = language.ByteGru(["a", "b", "c"], hidden=3, window=6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(97, 120, (6, 4)), np.array([0, 1, 2, 0])
    _, g = net.gradients(x, y)
    for k in net.p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        was, e = net.p[k][i], 1e-3
        net.p[k][i] = was + e
        up = net.gradients(x, y)[0]
        net.p[k][i] = was - e
        slope = (up - net.gradients(x, y)[0]) / 2 / e
        net.p[k][i] = was
        assert slope == pytest.approx(float(g[k][i]), rel=0.1)


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    low = reachable(300, edges)
    assert found == {i: low[i] for i in range(300) if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), small=small).collect() == []


@pytest.mark.parametrize("max_ids,max_weight", [(1000, 1000), (6, 1000), (4, 9), (2, 1000)])
def test_links_connect_all_that_share_a_set(spark, max_ids, max_weight):
    """Numbers less than 5 apart are linked if a set has both."""
    r = random.Random(max_ids)
    sets = {s: r.sample(range(400), r.choice([2, 3, 9, 40])) for s in range(25)} | {100: list(range(500, 560)), 101: [500, *range(520, 590, 3)], 102: [900, 901]}
    rows = [(s, i, min(ids), 1 + i % 3) for s, ids in sets.items() for i in ids]

    def link(items):
        yield from ((x, y) for x in range(len(items)) for y in range(x) if abs(items[x] - items[y]) < 5)

    contents = spark.range(1000).selectExpr("id", "id as content")
    found = groups.link_sets(spark.createDataFrame(rows, "node long, id long, root long, weight long"), contents, int, link, max_ids, max_weight).collect()
    pairs = [(a, b) for ids in sets.values() for a in ids for b in ids if b < a < b + 5]
    assert all(abs(x.a - x.b) < 5 for x in found)
    low = reachable(1000, [(x.a, x.b) for x in found])
    assert pairs and all(low[a] == low[b] for a, b in pairs)


def test_links_of_a_large_group_read_each_content_once_for_a_block(spark):
    """Overlapping sets of one large group: every pair is compared, but not once for each set."""
    n, max_ids = 120, 20
    r = random.Random(8)
    rows = [(s, i, 0, 1) for s in range(30) for i in sorted({0, *r.sample(range(n), 100)})]
    read = spark.sparkContext.accumulator(0)

    def prepare(x):
        read.add(1)
        return x

    def link(items):
        yield from ((x, y) for x in range(len(items)) for y in range(x) if abs(items[x] - items[y]) == 1)

    contents = spark.range(n).selectExpr("id", "id as content")
    sets = spark.createDataFrame(rows, "node long, id long, root long, weight long")
    found = groups.link_sets(sets, contents, prepare, link, max_ids, 10**6).collect()
    assert set(reachable(n, [(x.a, x.b) for x in found])) == {0}
    assert read.value <= n * (1 + n // max_ids)


@pytest.mark.parametrize("spread", [1, 40])
def test_connect_joins_all_close_pairs_of_a_key_without_all_pairs(spread):
    """One large part with a few items apart in every key: pairs inside the part are looked at for the first places only."""
    r, n, looked = np.random.default_rng(spread), 900, 0
    value = np.where(r.random(n) < 0.98, 0, r.integers(1, 1 + spread, n) * 10)
    item = np.concatenate([r.permutation(n), r.permutation(n)[:600], r.permutation(n)[:9], r.permutation(n)[:2]])
    key = np.repeat(np.arange(4), [n, 600, 9, 2])

    def close(a, b):
        nonlocal looked
        looked += len(a)
        return value[a] == value[b]

    label = groups.connect(key, item, np.arange(n), close)
    assert all((label[a] == label[b]) == (value[a] == value[b]) for a in range(0, n, 7) for b in range(n))
    assert looked < 120 * n


def test_similar_sets_against_all_pairs():
    """Sets around one text, with some apart from it, in groups with and without notes of the pairs that differ."""
    r = np.random.default_rng(3)
    sets = []
    for i in range(150):
        s = np.arange(60, dtype=np.uint64)
        s[r.permutation(60)[: r.integers(0, 14 if i % 5 else 40)]] += np.uint64(1000 + 100 * i)
        sets.append(np.sort(s[: r.integers(40, 61)]))
    linked = [(a, b) for a in range(150) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    for remembered in (8192, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near, "_REMEMBERED", remembered)
            found = list(near._linked(sets))
        assert set(found) <= {(b, a) for a, b in linked} and reachable(150, found) == reachable(150, linked)
    assert len(set(reachable(150, linked))) > 5


def test_packing_fills_windows_with_the_best_neighbours(spark):
    """Every piece, against plain BM25 over all documents in a single shard."""
    from collections import Counter
    from math import log1p

    from tokenizers import Tokenizer

    path, window = public_tokenizers.path("word_bpe_49k.json"), 256
    rows = [(7 * i, prose(R.randint(1, 60), 900 + i % 31), *ROWS[0][2:]) for i in range(60)] + [(1000, None, *ROWS[0][2:]), (1001, prose(400, 9), *ROWS[0][2:])]
    t = Tokenizer.from_file(path)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x, *_ in rows}
    df, mean = Counter(w for own in ids.values() for w in set(own)), sum(map(len, ids.values())) / len(ids)
    idf = {w: log1p((len(ids) - n + 0.5) / (n + 0.5)) for w, n in df.items()}

    def heavy(own):
        tf = Counter(own)
        best = sorted(tf, key=lambda w: (-(idf[w] * tf[w] / (tf[w] + packing.K1) if df[w] > 1 else -1), w))
        return best[0], best[min(1, len(best) - 1)]

    def score(seed, other):
        tf, norm = Counter(ids[other]), packing.K1 * (1 - packing.B + packing.B * len(ids[other]) / mean)
        return sum(idf[w] * tf[w] * (packing.K1 + 1) / (tf[w] + norm) for w in sorted(set(ids[seed])) if w in tf)

    order = sorted(ids, key=lambda d: (*heavy(ids[d]), d))
    left, placed, filled = list(order), [], 0
    while left:
        seed = left.pop(0)
        placed.append(seed)
        filled += len(ids[seed])
        while filled % window and left:
            for near in sorted(left, key=lambda d: -score(seed, d)):
                room = window - filled % window
                left.remove(near)
                placed.append(near)
                filled += len(ids[near])
                if len(ids[near]) >= room:
                    seed = near
                    break
    rows = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), path, window=window).collect()
    found = []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if not r.start:
            found.append(r.doc_id)
    assert found[: len(placed) - 8] == placed[: len(placed) - 8]  # the last window is dealt to powers of two
    assert sorted(found) == sorted(placed)


def test_word_encoder_agrees_with_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.WordEncoder(path, remember=300)
    bits = [" ", "  ", "\n", "é", "É", "é", "Σ", "ÿ", "Ÿ", "×", "÷", "ß", "İ", "'s", "'S", "n't", "<|endoftext|>", "<|", "ab", "The", "aaa", "x1", "12", "--", "中", "🙂", " ", "\u0085", "\x1c", "ª", "À", "Þ", "_", "ﬁ", "\x00", "'", "ing", "stration", "o" * 50]
    for _ in range(5):
        texts = ["".join(R.choice(bits) for _ in range(R.randint(0, 12))) for _ in range(2000)] + [None, "", "antidisestablishmentarianism " * 3]
        ids, ends = own.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_key_ranges_part_no_key():
    r = np.random.default_rng(7)
    for n in (1, 5, 1024, 5000, 20_000):
        keys = np.sort(r.integers(0, r.integers(1, n + 1), n))
        cuts = suffixes._key_ranges(keys)
        assert [x for x, _ in cuts] == [0, *(y for _, y in cuts[:-1])] and cuts[-1][1] == n
        assert all(keys[x - 1] != keys[x] for x, _ in cuts[1:])
        longest = np.bincount(keys).max()
        assert all(y - x <= suffixes._SORTED + longest for x, y in cuts)


HELD_BY_A_TASK = """
import os, random, sys
import pyarrow as pa
from sluice.llm import near

class Table:
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run

def held():
    size, resident, shared = map(int, open("/proc/self/statm").read().split()[:3])
    return (resident - shared) * os.sysconf("SC_PAGESIZE") >> 20

def batches():
    rng = random.Random(5)
    for _ in range(2):
        texts = [" ".join(f"{rng.getrandbits(28):x}" for _ in range(250)) for _ in range(8000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

run = near.sketches(Table())
before = held()
for _ in run(batches()):
    pass
del _
print(before, held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="/proc")
def test_a_task_gives_back_the_memory_of_its_peak():
    done = subprocess.run([sys.executable, "-c", HELD_BY_A_TASK], capture_output=True, text=True, check=True, cwd=Path(groups.__file__).parents[2])
    before, after = map(int, done.stdout.split()[-2:])
    assert after - before < 50
