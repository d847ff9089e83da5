"""The operators against brute-force versions, on small tables with nulls, empty, very long and repeated texts, ties and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, fingerprints, line_dedup, mixing, near_duplicates, neighbours, pieces, pii, quality, simhash, substrings, token_counts
from tessera.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows, columns="doc_id long, text string, size string, source string, copies string"):
    """Rows with columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, "size", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, "copies") for i, t in rows], columns)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "zwei", "中文", "x.", "THE", "the", "of"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 80)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "long " * 5000), (204, "nospace" * 3000), (None, "no key at all"), (205, "\n".join(["A line that many documents hold, in full, each time."] * 2))]
    return rows + [(300 + i, "A line that many documents hold, in full, each time.  \nown " + str(i)) for i in range(6)]


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD_BPE)
    rows = [*texts, (400, "a<|endoftext|>B İΣ ſ don't  I'LL 42"), (401, "\x1c\x85　é")]
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, rows), WORD_BPE).collect()}
    for i, t in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048)
    counter, draw = token_counts.MergeCounter(WORD_BPE, chunks=50, words=50), random.Random(1)
    pool = [chr(c) for c in (*range(0x250), *range(0x300, 0x3D0), *range(0x2000, 0x2070), 0x3000, 0xAC00, 0x1F600)] + ["<|endoftext|>", "'s", " "]
    for _ in range(3000):
        t = "".join(draw.choices(pool, k=draw.randint(0, 12)))
        assert counter.count(t) == len(own.encode(t, add_special_tokens=False).ids), repr(t)
    assert token_counts.token_counts(frame(spark, []), WORD_BPE).count() == 0


def slow_simhash(text):
    words = WORDS("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(keys, linked):
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_groups(spark, texts):
    rows = [(i, t) for i, t in texts if i is not None]
    fp = {i: slow_simhash(t) for i, t in rows}
    want = grouped(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in fp.items()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert [r.component_id for r in simhash.simhash_groups(frame(spark, [(None, "one")])).collect()] == [None]


def test_simhash_groups_of_null_keys(spark):
    """Rows without a key are told apart by their fingerprints: one near a document, one equal to it, others near each other or nothing."""
    draw = random.Random(31)
    vocabulary = [f"w{i}" for i in range(2000)]
    one, two, three = (draw.choices(vocabulary, k=900) for _ in range(3))
    rows = [(5, " ".join(one)), (None, " ".join([*one[:-1], "x"])), (None, " ".join(one)), (None, " ".join(two)), (None, " ".join([*three, "y"])), (None, " ".join([*three, "z"])), (9, " ".join(three))]
    fps = [slow_simhash(t) for _, t in rows]
    sets = grouped(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = []
    for i, (k, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i] and rows[j][0] is not None]
        want.append((str(k), f"{fps[i]:016x}", min(keys) if keys else None))
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {w[2] for w in want if w[0] == "None"} >= {None, 5}


def test_a_key_ties_its_texts(spark):
    rows = [(1, "a b c d"), (1, "quite other words here"), (7, "quite other words here"), (8, "and more of another kind")]
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(frame(spark, rows)).collect()} == {1: 1, 7: 1, 8: 8}


@pytest.mark.parametrize("distance", [0, 2, 6])
def test_hamming_links_lose_none(spark, distance):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << draw.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    points = spark.createDataFrame([(int(v), i) for i, v in enumerate(fps.view(np.int64))], "fp long, node long")
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= distance
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    assert {tuple(sorted((r.a, r.b))) for r in simhash.hamming_links(points, distance).collect()} == want
    for most in (20_000, 1):  # whole values, and values cut into shards
        forest = [(r.a, r.b) for r in simhash.hamming_forest(points, distance, most).collect()]
        assert grouped(range(len(fps)), forest) == grouped(range(len(fps)), want)


def test_forest_of_a_dense_value(spark):
    """Thousands of pairs under one value: two balls far apart stay two sets, whole or in shards."""
    ball = np.array([0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64)
    fps = np.unique(np.concatenate([ball, ~ball]))
    points = spark.createDataFrame([(int(v), i) for i, v in enumerate(fps.view(np.int64))], "fp long, node long")
    for most in (20_000, 300):
        sets = grouped(range(len(fps)), [(r.a, r.b) for r in simhash.hamming_forest(points, 4, most).collect()])
        assert len(set(sets.values())) == 2


def test_partitions_follow_the_corpus():
    assert [simhash.partitions_for(n, 2, 1.0) for n in (3, 40_000, 10**9)] == [3, 3, 2]
    assert simhash.partitions_for(40_000, 8, 0.05) >= simhash.partitions_for(10**8, 8, 0.05) >= 2


def test_near_duplicates(spark):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choices(vocabulary, k=200) for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for n in range(3):
        for i, w in enumerate(base):
            w = list(w)
            w[draw.randrange(200)] = f"edit{n}"
            rows.append((100 + 10 * n + i, " ".join(w)))
    rows += [(50, " ".join(reversed(base[0]))), (60, None), (61, ""), (3, rows[3][1]), (None, "odd one")]
    kept = near_duplicates.drop_near_duplicates(frame(spark, rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 0, 1, 2, 3, 4, 5, 50, 60]
    assert kept.columns == ["doc_id", "text", "size", "source", "copies"]
    pairs = near_duplicates.near_duplicate_groups(frame(spark, rows), most=2, most_sets=2)  # bands and open sets cut into shards
    whole = near_duplicates.near_duplicate_groups(frame(spark, rows))
    split = lambda df: sorted(sorted(str(r.k) for r in rs) for rs in _by(df.collect()).values())
    assert split(pairs) == split(whole)
    assert near_duplicates.drop_near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_contiguous_edits(spark):
    """All pairs of similarity 0.8 by brute force: appended and inserted passages, and short texts with a changed end."""
    draw = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for n in [13, 20, 30, 50, 80, 150, 300, 600] * 12:
        w, other = draw.choices(vocabulary, k=n), [f"x{draw.randrange(5000)}" for _ in range(n)]
        at, changed = draw.randrange(n), draw.randint(1, 4)
        texts += [w, w + other[: int(0.23 * n)], w[:at] + other[: int(0.15 * n)] + w[at:], w[:-changed] + other[:changed]]
    sets = [near_duplicates.shingle_set(w, 5) for w in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_duplicates.alike(sets[i], sets[j], 0.8)]
    rows = near_duplicates.near_duplicate_groups(frame(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])).collect()
    got = {r.k: r.g for r in rows}
    want = grouped(range(len(texts)), links)
    assert len(links) > 200 and all(got[i] == got[j] for i, j in links)
    assert len(set(got.values())) == len(set(want.values()))


@pytest.mark.parametrize("most, most_sets", [(20_000, 1_000), (50, 20)])
def test_near_duplicates_of_a_template(spark, most, most_sets):
    """Texts of one template below the similarity, all of which are candidates, with chains of links among them."""
    draw = random.Random(12)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in draw.sample(range(60), 3):
            w[at] = f"x{i}-{at}"
        texts += [w, w[:-1] + [f"y{i}"]] if i % 3 == 0 else [w]
    texts += [base[:-1] + [f"z{i}"] for i in range(90)]  # one label of many texts
    sets = [near_duplicates.shingle_set(w, 5) for w in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_duplicates.alike(sets[i], sets[j], 0.8)]
    got = {r.k: r.g for r in near_duplicates.near_duplicate_groups(frame(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), most=most, most_sets=most_sets).collect()}
    want = grouped(range(len(texts)), links)
    assert 20 < len(set(want.values())) and all(got[i] == got[j] for i, j in links) and len(set(got.values())) == len(set(want.values()))


def test_bands_meet_at_the_similarity_they_are_for():
    draw = np.random.default_rng(4)
    one = 0
    for _ in range(400):
        h = draw.integers(0, 1 << 64, 100, np.uint64)
        x, y = (near_duplicates.band_keys(near_duplicates.smallest_hashes(g, 145), 29) for g in (h[:90], h[10:]))
        one += (x == y).sum()  # Jaccard 0.8
    assert near_duplicates.bands_for(0.8) == 29 and abs(one / (400 * 29) - 0.8**5) < 0.03 and near_duplicates.bands_for(1.0) == 1


def _by(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.g].append(r)
    return out


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in grouped({x for p in links for x in p}, links).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_winnowing(spark, texts):
    def brute(text, k, w):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(codes):
            return []
        hashes = [int(fingerprints.gram_hashes(codes[i : i + k], k, 4000)[0]) for i in range(max(1, len(codes) - k + 1))]
        out = []
        for i in range(max(1, len(hashes) - w + 1)):
            window = hashes[i : i + w]
            at = i + max(j for j, h in enumerate(window) if h == min(window))
            out += [] if out and out[-1][1] == at else [(min(window), at)]
        return out

    draw = random.Random(0)
    for _ in range(150):
        t, k, w = "".join(draw.choices("abé", k=draw.randint(0, 150))), draw.randint(1, 8), draw.randint(1, 12)
        assert list(zip(*map(list, fingerprints.winnow(t, k, w)))) == brute(t, k, w)
    rows = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0]))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, texts)).collect()}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        h, e = fingerprints.winnow(t), fingerprints.winnow(edited)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (fingerprints.as_hex(*h), fingerprints.as_hex(*e))
        assert got[i].near_next == fingerprints.likeness(h[0], fingerprints.winnow(after)[0]) and got[i].near_edited == fingerprints.likeness(h[0], e[0])
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    assert fingerprints.fingerprints(frame(spark, texts)).count() == len(texts)


def test_successors_of_a_frequent_key(spark):
    """A third of the rows have one key: they follow each other by hash, in ranges of their own, and every row has one successor."""
    rows = [(i, f"text {i}") for i in range(300)] + [(150, f"again {i}") for i in range(150)] + [(None, None), (None, "nobody's")]
    df = frame(spark, rows)
    hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    turn = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t in rows))
    want = []
    for n, (known, i, _, t) in enumerate(turn):
        cut, after = len(t) // 4, turn[(n + 1) % len(turn)][3]
        want.append((i if known else None, hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in fingerprints.edited_fingerprints(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    sizes = [r["count"] for r in fingerprints._in_turn(df, "text", "doc_id").where("not ghost").groupBy("deal").count().collect()]
    assert max(sizes) < 100


def test_short_texts_and_stretches_keep_a_likeness():
    draw = random.Random(3)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    for n in range(40, 88):
        t = word(n)
        assert fingerprints.likeness(fingerprints.winnow(t)[0], fingerprints.winnow(t[: n - n // 4] + word(n // 4))[0]) > 0
    for _ in range(50):
        shared = word(34)
        assert fingerprints.likeness(fingerprints.winnow(word(500) + shared + word(300))[0], fingerprints.winnow(word(200) + shared + word(400))[0]) > 0


def test_mixing(spark, texts):
    rows = mixing.mix_sources(frame(spark, texts)).collect()
    again = mixing.mix_sources(frame(spark, list(reversed(texts)))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    total, by = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORDS(r.text or "")) and r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        by[r.source].append(r)
    assert sum(own[0].target for own in by.values()) == pytest.approx(total)
    for own in by.values():
        assert own[0].target <= 3 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    mixed = mixing.mixed_rows(frame(spark, texts))
    assert mixed.count() == sum(r.copies for r in rows) and mixed.columns == frame(spark, []).columns
    assert {(r["size"], r.copies) for r in mixed.collect()} == {("size", "copies")}  # columns of those names stay what they were
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_mixing_in_few_bins(spark, monkeypatch):
    """Few bins of either kind, so that cuts fall at their edges: the same documents as with many."""
    draw = random.Random(2)
    df = spark.createDataFrame([(i, "w " * draw.randint(0, 40), draw.choice("abcdef")) for i in range(300)], "doc_id long, text string, source string")
    found = []
    for bins in (2, 7, 4096):
        monkeypatch.setattr(mixing, "BINS", bins)
        found.append(sorted((r.doc_id, r.copies) for r in mixing.mix_sources(df).collect()))
    assert found[0] == found[1] == found[2]


def test_chances_differ_within_a_source(spark):
    """Documents of one source get their extra copy with chances that fall with their sizes, and the words come out right all the same."""
    rows = [(i, "w " * (10 if i % 2 else 160), "a" if i < 2000 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix_sources(df, weights=(1, 3)).collect() if r.source == "a"]
    share = {n: sum(r.copies for r in got if r["size"] == n) / sum(r["size"] == n for r in got) for n in (10, 160)}
    assert share[10] > 1.5 * share[160] > 0 and abs(sum(r.taken for r in got) - got[0].target) <= 80
    plan = {r.src: r for r in mixing.mix_plan(df, weights=(1, 3)).collect()}
    assert 0 < plan["a"].p < 1 and plan["a"].whole == 0


def test_pieces_agree_with_the_library_in_its_unigram_mode(spark, tmp_path, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000.0)  # the library sums single-precision numbers
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model")), pieces.Pieces(str(tmp_path / "unigram.model"))
    draw = random.Random(2)
    pool = [chr(c) for c in (*range(32, 127), 0xE9, 0x4E2D, 0x1F600, 0x3B1, 10, 9)] + [" "] * 10
    for t in [t[:150] for _, t in texts if t] + ["".join(draw.choices(pool, k=draw.randint(0, 25))) for _ in range(2000)]:
        assert list(ours.encode(t)) == theirs.encode(t)
        assert ours.decode(ours.encode(t)) == t
    rows = pieces.round_trip(frame(spark, texts), PIECES).collect()
    assert len(rows) == len(texts) and all(r.same for r in rows)
    encoded = pieces.encode(frame(spark, texts), PIECES)
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PIECES).collect()} == {i: t or "" for i, t in texts}
    assert pieces.encode_rows(frame(spark, texts), PIECES).columns == ["doc_id", "size", "source", "copies", "ids", "n_pieces", "same"]


def slow_pii(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[0::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_pii(spark):
    draw = random.Random(3)
    pool = [*"abZ019..@@@++--__% ()", "é", "😀", "12.34.5.6", "a@b.co", "4111 1111 1111 1111", "+1 (555) 123-4567", " at ", " dot ", "[at]", "\n", "call "]
    rows = [(i, "".join(draw.choices(pool, k=draw.randint(0, 30)))) for i in range(1500)] + [(6000, None), (6001, ""), (6002, "7" * 30000), (6003, "a.b@" * 3000), (None, "x@y.z"), (5, "again a@b.co")]
    got = pii.pii_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want, have = defaultdict(set), defaultdict(set)
    for i, t in rows:
        want[i].add(slow_pii(t or ""))
    for r in got:
        have[r.doc_id].add(r.base)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) and r.n_ip == r.base.count("ip:")
    assert have == want
    said = [(1, "call (555) 123-4567 or write bob [at] example [dot] com, then 10[.]2[.]3[.]4, mail a.b@c.de 😀 +1 (555) 123-4567!"), (2, None), (3, "the order 555-123-4567 came at noon dot by dot")]
    assert [r.text for r in pii.redact(frame(spark, said)).orderBy("doc_id").collect()] == ["call [phone] or write [email], then [ip], mail [email] 😀 [phone]!", None, said[2][1]]
    plan = pii.pii_report(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_beyond_the_base(spark):
    """What the trees add, in contexts that neither they nor the thresholds have seen; base spans overlap none of it."""
    booster = pii.train(spark)
    rows = pii.example_candidates(spark).where(F.col("part") == pii.MEASURE).collect()
    for kind in range(4):
        own = [(booster.score(tuple(r[f] for f in pii.FEATURES)) >= booster.thresholds[kind], r.label) for r in rows if r.kind == kind]
        right = sum(a and y for a, y in own)
        assert right >= 0.9 * sum(a for a, _ in own) > 0 and right >= 0.75 * sum(y for _, y in own), (kind, right, sum(a for a, _ in own), sum(y for _, y in own))
    said = "cards 4111111111111111 5500005555555559 and +1 (555) 123-4567 4111111111111112 then 12 and 2024"
    got = pii.pii_spans(spark.createDataFrame([(1, said)], "doc_id long, text string")).collect()
    assert {r.match for r in got} >= {"4111111111111111", "5500005555555559", "+1 (555) 123-4567"} and not {r.match for r in got} & {"12", "2024"}


def test_quality(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    good = lambda: " ".join(draw.choices(words, k=60))
    bad = lambda: " ".join(w.upper() + "!!" for w in draw.choices(words, k=60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(210, 1), (210, 0), (211, None), (None, 1)], "doc_id long, quality int")
    df = frame(spark, rows)
    model = quality.fit(df, labels, train=F.lit(True))
    got = {r.doc_id: r for r in quality.quality_scores(df, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(200, 300)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[400].score == got[401].score and len(got) == len(rows)
    one = quality.fit(df, labels.where("quality = 1"), train=F.lit(True))
    assert len({r.score for r in quality.quality_scores(df, one).collect()}) == 1
    assert quality.quality_scores(frame(spark, []), model).count() == 0


def test_quality_of_held_out_labels(spark):
    """The query's own fold on real tables: labels it hasn't seen, by their ranks and at its threshold."""
    from tessera.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = queries.op7_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 500 and above > 0.98 and sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)


def test_a_repeated_key_teaches_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, y: seen.append(len(rows)))
    df = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other"), (2, None)])
    quality.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), train=F.lit(True))
    quality.fit(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), train=F.lit(True))
    assert seen == [2, 0]


def test_descent_reaches_the_optimum():
    """Small separable rows: the dual solution's margins are all at least one."""
    rows, y = [np.array([i % 4, 10 + i % 3]) for i in range(40)], np.array([int(i % 4 > 1) for i in range(40)])
    ratio = quality.log_ratios(rows, y)
    w, b = quality.descend(rows, y, ratio, cost=100.0, rounds=400)
    assert all((2 * t - 1) * (w[r].sum() / np.sqrt(2) + b) > 0.98 for r, t in zip(rows, y))


def test_nearest(spark):
    draw = np.random.default_rng(9)
    v = draw.standard_normal((600, 12)).astype(np.float32)
    v[300:330] = v[300]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [None] * 12), (1004, [float("inf")] + [0.0] * 11), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest_vectors(df, lambda i: F.pmod(i, F.lit(50)) == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    m, hits = v.astype(np.float64), 0
    for q in range(0, 600, 50):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and np.allclose([f[2] for f in found], d[[f[1] for f in found]], rtol=1e-12)
        hits += len({f[1] for f in found} & set(best.tolist()))
        if q == 300:
            assert [f[1] for f in found] == list(range(301, 311))
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.97 * 120
    few = neighbours.nearest_vectors(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), lambda i: i == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.nearest_vectors(df.limit(0), lambda i: i == 0).count() == 0


def test_search_reaches_groups_without_an_entry(spark):
    """100 tight groups of 40 with an exact graph of 32 neighbours, whose edges never leave a group, and few entry points."""
    draw = np.random.default_rng(2)
    v = np.repeat(draw.standard_normal((100, 16)) * 10, 40, axis=0) + draw.standard_normal((4000, 16)) * 0.01
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    near = np.argsort(d, axis=1)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "node long, v array<double>")
    graph = spark.createDataFrame([(i, near[i, 1:33].tolist(), d[i, near[i, 1:33]].tolist(), [False] * 32) for i in range(4000)], neighbours._LIST)
    queries = points.where("node % 41 = 0").select(F.col("node").alias("q"), "v")
    got = neighbours.greedy_search(points, graph, queries, 11, beam=64, entries=16).collect()
    hits = sum(r.node in near[r.q, :11] for r in got)
    assert hits >= 0.95 * 11 * queries.count()


@pytest.mark.parametrize("noise, scale, kind", [(1e-5, 1.0, "float"), (1e-3, 1.0, "float"), (1e-4, 1e6, "double"), (1e-9, 1.0, "double")])
def test_near_copies_are_told_apart(spark, noise, scale, kind):
    """1,500 copies of one vector beside others; components above 65,504 too."""
    draw = np.random.default_rng(6)
    one, own = draw.standard_normal(16), np.float32 if kind == "float" else np.float64
    v = (np.concatenate([one * (1 + noise * draw.standard_normal((1500, 16))), draw.standard_normal((500, 16))]) * scale).astype(own)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], f"vec_id long, embedding array<{kind}>")
    m, asked = v.astype(np.float64), list(range(0, 2000, 40))
    best = {q: set(np.argsort(np.where(np.arange(2000) == q, np.inf, ((m - m[q]) ** 2).sum(1)), kind="stable")[:10].tolist()) for q in asked}
    for most in (4_000, 200):  # the group in one leaf, and dealt to several
        found = neighbours.nearest_vectors(df, lambda i: F.pmod(i, F.lit(40)) == 0, most=most).collect()
        assert sum(r.vec_id in best[r.query_id] for r in found) >= 0.95 * 10 * len(asked)


@pytest.mark.parametrize("window, most", [(7, 20000), (7, 3), (13, 5)])
def test_substrings(spark, window, most):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("abc", k=draw.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "a " * 300), (103, "a " * 100 + "b " + "a " * 50), (None, "a " * 20), (102, "b " * 30)]
    first = {}
    for i, t in rows:
        w, i = WORDS(t or ""), -1 if i is None else i
        for j in range(len(w) - window + 1):
            x = tuple(w[j : j + window])
            first[x] = min(first.get(x, i), i)
    want = []
    for i, t in rows:
        w, gone = WORDS(t or ""), set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (-1 if i is None else i):
                gone.update(range(j, j + window))
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.substring_dedup(frame(spark, rows), window=window, most=most).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.substring_dedup(frame(spark, []), window=window).count() == 0


def test_rows_of_one_key_are_told_apart(spark):
    """Hundreds of texts under a null key and under one other: what one of them loses, no other does."""
    draw = random.Random(11)
    shared = " ".join(f"s{i}" for i in range(13))
    rows = [(1, shared)] + [(k, " ".join(f"{draw.random()}" for _ in range(20))) for k in [None] * 400 + [7] * 400] + [(7, f"a b {shared} c"), (None, f"d {shared}")]
    got = substrings.substring_dedup(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got if r.n_removed) == [("1", 13), ("7", 13)] and len(got) == len(rows)


@pytest.mark.parametrize("batches", [1, 9])
def test_lines(spark, texts, batches):
    rows = [*texts, (300, "a line THAT many documents hold, in full, each time.\t")]  # a key that comes twice
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(order(i))
    out = lambda i, line: len(holders.get(key(line), ())) >= 5 and max(holders[key(line)]) != order(i)
    want = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not out(i, x)]
        want.append((str(i), len(own), len(own) - len(stay), "\n".join(stay)))
    df = line_dedup.line_dedup(frame(spark, rows), batches=batches)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in df.collect()) == sorted(want)
    assert any(w[2] for w in want) and "Python" not in df._jdf.queryExecution().toString()
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_runs_settle(spark):
    """Batches of descending documents: hashes that enough of them hold leave at the anti-join, others add up over runs."""
    rows = lambda *r: spark.createDataFrame(list(r), "h1 long, h2 long, doc long")
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2)
    runs.add(rows((1, 1, 90), (1, 1, 91), (1, 1, 91), (2, 2, 95)))
    batch = rows((1, 1, 80), (2, 2, 81), (3, 3, 81))
    assert {tuple(r) for r in runs.fresh(batch).collect()} == {(2, 2, 1, 81), (3, 3, 1, 81)}
    runs.add(batch)
    assert runs.fresh(rows((2, 2, 70), (3, 3, 70))).select("h1").collect()[0].h1 == 3  # settled by the merge of both runs
    runs.add(rows((2, 2, 70), (4, 4, 70)))
    assert {tuple(r) for r in runs.repeated().collect()} == {(1, 1, 91), (2, 2, 95)}
    assert max(len(level) for level in runs.levels) < 2


def test_lines_settle_on_the_way(spark, monkeypatch):
    """In the operator itself the anti-join keeps later documents of a common line out of the runs."""
    added = []
    put = line_dedup.LineRuns._put

    def seen(self, level, rows):
        if level == 0:
            added.append(rows.agg(F.sum("n")).first()[0] or 0)
        put(self, level, rows)

    monkeypatch.setattr(line_dedup.LineRuns, "_put", seen)
    line = "a line of more than forty characters that all documents hold"
    got = line_dedup.line_dedup(frame(spark, [(i, line) for i in range(80)]), batches=4).collect()
    assert [r.doc_id for r in got if not r.n_dropped] == [79] and sum(added) == added[0] and len(added) == 4


def test_line_runs_have_files_by_their_rows(spark, tmp_path, monkeypatch):
    """A run's files are no more tasks of each later batch, and of the driver's bookkeeping, than its rows are worth."""
    files = []
    put = line_dedup.LineRuns._put

    def seen(self, level, rows):
        put(self, level, rows)
        files.extend(len(r.inputFiles()) for held in self.levels for r in held)

    monkeypatch.setattr(line_dedup.LineRuns, "_put", seen)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = [(i, "\n".join(f"a line of more than forty characters, number {j}" for j in range(i % 7, i % 7 + 60))) for i in range(40)]
        got = line_dedup.line_dedup(frame(spark, rows), batches=4)
        kept = [line for r in got.collect() for line in r.kept.split("\n") if line]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files) <= 8 and len(kept) == len(set(kept)) == 66


def test_release_trims_the_native_heap(spark, monkeypatch):
    """The driver's JVM is asked to give freed native memory back, besides collecting its garbage; without the command nothing breaks."""
    assert common.trim_native_heap(spark)
    asked = []
    monkeypatch.setattr(common, "trim_native_heap", asked.append)
    common.release(spark)
    assert asked == [spark]
