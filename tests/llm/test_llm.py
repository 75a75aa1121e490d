"""The text operators against brute force, round trips and edge cases."""

import base64
import gzip
import hashlib
import io
import itertools
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from voxloom.llm import chat, exact_dedup, kernels, language, media, mixing, near_dedup, packing, quality, substring_dedup, warc
from voxloom.llm.storage import documents, fetch, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, row long, key string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or ""), "x", 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, 5000, n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in (5, 30, 60, 90)]
    odd = [None, "", "   \n", "one", "one two", "One  TWO", "é " * 50, "a\x1fb c", base, base.replace(" ", "  "), " " + base, prose(2, 30_000), "same " * 200]
    return odd + near + [prose(s, 80) for s in range(3, 9)] + [prose(10, 40) + " " + base, base + " " + prose(11, 40)]


def brute_classes(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates_match_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert got == brute_classes(texts, 3, 85)


def test_split_regions_still_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 4)
    words = prose(5, 200).split()
    group = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(0, 200, 10)]
    got = near_dedup.near_duplicates(docs(spark, group), 3, 85).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize(("percent", "own", "edits"), [(80, 9, 11), (85, 7, 8)])
def test_sparse_pairs_inside_a_crowd_are_found(spark, monkeypatch, percent, own, edits):
    """Texts of a crowd are too far from each other to link, but each third one has a partner just at the threshold."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    r = np.random.default_rng(percent)
    base = [f"b{k}" for k in range(302)]

    def edited(words, n, name):
        out = list(words)
        for k in r.choice(100, n, replace=False):
            out[3 * k] = f"{name}x{k}"
        return out

    crowd = [edited(base, own, f"n{i}") for i in range(150)]
    group = [" ".join(w) for w in crowd + [edited(w, edits, f"p{i}") for i, w in enumerate(crowd[::3])]]
    want = brute_classes(group, 3, percent)
    assert 45 <= sum(c != i for i, (_, c) in want.items()) < 100
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs(spark, group), 3, percent).collect()}
    assert got == want


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary")
    assert {bytes(r["class"]) for r in near_dedup.components(links).collect()} == {b"\0"}


def test_exact_duplicates_match_brute_force(spark, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, count = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (first[t], count[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}


def test_fingerprints_compose():
    raw = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    whole = exact_dedup.chunk_fingerprint(raw)
    left, right = exact_dedup.chunk_fingerprint(raw[:25_000]), exact_dedup.chunk_fingerprint(raw[25_000:])
    assert exact_dedup.combined(left, right, 35_000) == whole
    shares = [exact_dedup.shifted(left, 35_000), exact_dedup.shifted(right, 0)]
    assert tuple(sum(x) % exact_dedup.PRIME for x in zip(*shares, strict=True)) == whole
    assert exact_dedup.combined(right, left, 25_000) != whole


def test_chunks_of_long_texts_are_dealt_and_compared(spark):
    base = prose(1, 60_000)
    size = len(base)
    assert size > 4 * exact_dedup.CHUNK
    swapped = base[: exact_dedup.CHUNK] + "x" + base[exact_dedup.CHUNK + 1 :]
    rows = [base, base.replace(" ", "\n\t"), swapped, base + " ", base[: exact_dedup.CHUNK], base[: exact_dedup.CHUNK + 1], base[: exact_dedup.CHUNK]]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in rows]
    assert got == {i: norm.index(t) for i, t in enumerate(norm)}


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_fingerprint", lambda raw: (0, 0, 0, 0))
    monkeypatch.setattr(exact_dedup, "MEMBERS", 2)
    monkeypatch.setattr(exact_dedup, "CHUNK", 3)
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(exact_dedup)
    try:
        texts = ["abxx", "cdxx", "abxx", "cdxx", "efxx", "abxx", "abxx", "abxy"]
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs(spark, texts)).collect()}
    finally:
        pickle.unregister_pickle_by_value(exact_dedup)
    assert got == {0: (0, 4), 1: (1, 2), 2: (0, 4), 3: (1, 2), 4: (4, 1), 5: (0, 4), 6: (0, 4), 7: (7, 1)}


def brute_passages(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = {}
    for k, w in enumerate(words):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return want


def passages(spark, texts, window):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(docs(spark, texts), window).collect()}


@pytest.mark.parametrize("window", [3, 20, 35, 70])
def test_repeated_passages_match_brute_force(spark, texts, window):
    assert passages(spark, texts, window) == brute_passages(texts, window)


def test_passages_that_repeat_at_some_levels_only(spark):
    r = np.random.default_rng(9)
    parts = [prose(40 + k, n).split() for k, n in enumerate((9, 10, 17, 18, 19, 34, 35, 36, 70))]
    mixed = []
    for k in range(60):
        filler = prose(500 + k, 40).split()
        part = parts[k % len(parts)]
        at = int(r.integers(0, 40))
        mixed.append(" ".join(filler[:at] + part + filler[at:]))
    mixed += [" ".join(["la"] * 90), " ".join(["la"] * 34), " ".join(prose(77, 30).split() * 3)]
    want = brute_passages(mixed, 35)
    assert passages(spark, mixed, 35) == want and sum(n > 0 for _, n, _ in want.values()) >= 20
    assert substring_dedup.level_lengths(35) == [9, 18, 35]


def test_words_of_one_letter_pattern_and_its_opposite_differ(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = prose(4, 34)
    assert passages(spark, [f"{word} {rest}", f"{other} {rest}"], 35) == brute_passages([f"{word} {rest}", f"{other} {rest}"], 35)


def test_media_round_trip(spark, texts):
    for form in ("pgm", "bmp"):
        got = {r.doc_id: r for r in media.stored_media(docs(spark, texts), form).collect()}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def plain_tile(image, shape):
    """Area means by exact overlaps, cell by cell."""
    h, w = image.shape
    out = np.zeros(shape)
    for i in range(shape[0]):
        for j in range(shape[1]):
            y0, y1, x0, x1 = i * h / shape[0], (i + 1) * h / shape[0], j * w / shape[1], (j + 1) * w / shape[1]
            total = 0.0
            for y in range(int(y0), min(h, int(np.ceil(y1 - 1e-12)))):
                for x in range(int(x0), min(w, int(np.ceil(x1 - 1e-12)))):
                    total += image[y, x] * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_columns_match_plain_versions(spark, form):
    texts = [None, "", "plain words " * 9, prose(3, 600), "é" * 333, "a", "a"]
    rows = [*enumerate(texts), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"media": F.lit(b"x"), "tile": F.lit(1), "n_bytes": F.lit("y")})
    got = media.stored_media(df, form).collect()
    assert len(got) == len(rows)
    by_payload = {r.payload_sha256: r for r in got}
    for _, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        r = by_payload[hashlib.sha256(payload).hexdigest()]
        head = b"P5\n64 %d\n255\n" % len(image)
        if form == "pgm":
            assert (r.media_bytes, r.media_sha256) == (len(head) + len(payload), hashlib.sha256(head + payload).hexdigest())
        else:
            assert r.media_bytes == 1078 + len(payload)
        small = np.load(io.BytesIO(bytes(r.tile)))
        assert np.abs(small - plain_tile(image, media.TILE)).max() <= 0.5 + 1e-6
        bits = "".join(str(int(small[y, x] < small[y, x + 1])) for y in range(8) for x in range(8))
        assert r.feature == f"{int(bits, 2):016x}"


def test_area_resize_keeps_the_mean():
    a = np.random.default_rng(0).integers(0, 256, (37, 64)).astype(np.uint8)
    assert media.area_resize(a, (8, 9)).mean() == pytest.approx(a.mean())
    assert (media.area_resize(a[:16, :18], (8, 9)) == a[:16, :18].reshape(8, 2, 9, 2).mean(axis=(1, 3))).all()
    assert (media.decode(media.encode_bmp(a)) == a).all()
    colour = b"P6\n# note\n2 1\n255\n" + bytes(range(6))
    assert media.decode(colour).shape == (1, 2, 3)


def test_language_choice_and_rejection(spark):
    r = np.random.default_rng(3)
    make = lambda parts: " ".join("".join(r.choice(parts, 3)) for _ in range(60))
    kinds = {"aa": ["ka", "lo", "mi", "pu"], "bb": ["ster", "und", "ich", "ach"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 34 !", None), (502, "", "bb")], "doc_id long, text string, lang string").withColumn("held_out", F.col("doc_id") >= 60)
    got = {x.doc_id: x for x in language.identify(df, language.learn_dictionaries(df.where("not held_out"))).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and all(got[i].lang_pred == "und" for i in (500, 501, 502))
    assert all(0 <= x.score <= 1 for x in got.values())
    strict = language.identify(df, language.learn_dictionaries(df), margin=1e9).collect()
    assert {x.lang_pred for x in strict} == {"und"}


def test_mixing_meets_targets(spark, texts):
    sources = [["a", "b", None, "c"][i % 4] for i in range(len(texts))]
    got = mixing.mix_plan(docs(spark, texts, sources)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == int(target[s]) for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(len(WORD.findall(t or "")) for t in texts))
    assert mixing.mix_plan(docs(spark, texts, sources).limit(0)).count() == 0


def test_prefix_sums_do_not_depend_on_the_ranges(spark, monkeypatch):
    key = F.when(F.col("id") < 60, F.md5(F.lit("same"))).otherwise(F.md5(F.col("id").cast("string")))
    rows = stored(spark.range(200).select(F.lit("g").alias("g"), key.alias("key"), F.when(F.col("id") < 60, 7).otherwise(F.col("id")).alias("v"), (F.col("id") * 9000).alias("row")), "test")
    sums = []
    for n in (1_000_000, 30, 3):
        monkeypatch.setattr(mixing, "RANGE_ROWS", n)
        got = mixing.prefix_sums(rows, "g", "v", 200).orderBy("before").collect()
        at = 0
        for r in got:
            assert r.before == at
            at += r.v
        sums.append(at)
    assert sums[0] == sums[1] == sums[2]


def test_mixing_counts_rows_of_one_id_apart(spark):
    rows = [(None, "a b c", "s", 1), (None, "d e f g", "s", 2), (None, "d e f g", "s", 3), (5, "h i", "s", 4), (5, "j", "t", 5), (6, None, "t", 6), (7, "k l m", None, 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times int").withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    for source in ("s", "t", None):
        mine = [r for r in plan if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    copies = sum(int(r.taken / r["size"] + 0.5) for r in plan if r["size"])
    assert out.count() == copies and out.where("doc_id = 6").count() == 0


def test_warc_round_trip(spark):
    html = ["<p>a\r\n\r\nb</p>", None, "", "é" * 10, "<p>a\r\n\r\nb</p>", "WARC/1.1\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://x/{i} y" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.page_captures(pages).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        last = max(k for k, o in enumerate(html) if (o or "") == (h or ""))
        r = got[i]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.payload_bytes == len(raw)
        assert (r.record_type, r.refers_to) == (("response", None) if last == i else ("revisit", last))
    assert warc.page_captures(pages.limit(0)).count() == 0


def test_warc_keeps_pages_with_equal_or_no_ids(spark):
    rows = [(None, "a"), (None, "bb"), (None, "bb"), (5, "ccc"), (5, "dddd"), (5, "dddd"), (6, "ccc"), (6, "ccc"), (None, "ccc")]
    pages = spark.createDataFrame([(i, "http://x/", h) for i, h in rows], "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_captures(pages).collect())
    want = [(None, 1, "response", None), (None, 2, "response", None), (None, 2, "response", None), (5, 3, "revisit", 6), (5, 4, "response", None)]
    want += [(5, 4, "response", None), (6, 3, "response", None), (6, 3, "response", None), (None, 3, "revisit", 6)]
    assert got == Counter(want)
    path = warc.shared_path(spark, "warc")
    warc.write(pages, path)
    records = warc.read_records(spark, path).collect()
    responses = {r.record_id for r in records if r.type == "response"}
    assert len({r.record_id for r in records}) == 3 * len(rows) and all(r.refers_to in responses for r in records if r.type == "revisit")


def test_warc_pages_over_the_bounds_and_members(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    big = "".join(f"<p>{k}\r\n\r\n</p>" for k in range(400_000))
    html = [big, "small", big[:-1], "x" * (17 << 20), *[f"page {k} " * 9000 for k in range(40)]]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = warc.shared_path(spark, "warc")
    warc.write(pages, path)
    got = warc.read_records(spark, path, with_payload=True).where("type = 'response'").collect()
    assert {int(re.search(r"capture:(\d+)", r.capture_id)[1]): bytes(r.payload) for r in got} == {i: h.encode() for i, h in enumerate(html)}
    files = [f for f in pathlib.Path(path).rglob("part-*")]
    assert len(files) > 5
    for f in files:
        raw, seen = f.read_bytes(), 0
        assert b"".join(warc.inflated(memoryview(raw))) == gzip.decompress(raw)
        while raw:
            tool = zlib.decompressobj(31)
            part, raw, seen = tool.decompress(raw), tool.unused_data, seen + 1
            assert part.startswith(b"WARC/1.1") or len(part) <= warc.MEMBER
        assert seen >= 3


def test_warc_reads_other_writers():
    raw = b"WARC/1.0\r\nwarc-type: warcinfo\r\nCONTENT-LENGTH:4\r\n\r\nabcd\r\n\r\n"
    raw += b"WARC/1.1\r\nWARC-Type:response\r\nWARC-Record-ID: <a>\r\nX: long\r\n  line\r\nContent-Length: 7\r\n\r\nno http\r\n\r\n"
    raw += b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Length: 15\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    for held in (raw, gzip.compress(raw), gzip.compress(raw[:50]) + gzip.compress(raw[50:])):
        rows = [warc._row(h, b, True) for h, b in warc.parse(held)]
        assert [(r[2], r[-1]) for r in rows] == [("warcinfo", None), ("response", b"no http"), ("response", b"")]
        assert rows[1][0] == "<a>"
    assert list(warc.parse(b"")) == []


def test_bucket_bounds_are_optimal():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, k = int(r.integers(1, 11)), int(r.integers(1, 6))
        lengths = np.sort(r.choice(60, n, replace=False))
        counts = r.integers(1, 20, n)
        bounds = packing.bucket_bounds(lengths, counts, k)

        def cost(b):
            return sum(int(c) * (min(x for x in b if x >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))  # noqa: B023

        best = min(cost({*map(int, chosen), int(lengths[-1])}) for m in range(min(k, n)) for chosen in itertools.combinations(lengths, m))
        assert cost(bounds) == best and len(bounds) <= k
    assert packing.bucket_bounds(np.array([], int), np.array([], int), 3) == []


def test_batches_hold_every_text_padded(spark, texts):
    more = [*texts, texts[3], texts[3]]
    made = packing.batches(docs(spark, more), buckets=4, budget=2000).collect()
    lengths = [len(WORD.findall(t or "")) for t in more]
    bounds = packing.bucket_bounds(np.array(sorted(set(lengths))), np.array([lengths.count(n) for n in sorted(set(lengths))]), 4)
    seen = Counter()
    for b in made:
        n = b.bucket_length
        assert n == bounds[b.bucket] and len(b.tokens) == n * len(b.doc_ids) and (len(b.tokens) <= 2000 or len(b.doc_ids) == 1)
        for k, (doc, size) in enumerate(zip(b.doc_ids, b.lengths, strict=True)):
            row = b.tokens[k * n : (k + 1) * n]
            assert row[size:] == [None] * (n - size) and n == min(x for x in bounds if x >= size)
            seen[doc, " ".join(row[:size])] += 1
    assert seen == Counter((i, " ".join(WORD.findall(t or ""))) for i, t in enumerate(more))
    full = Counter(b.bucket for b in made if len(b.doc_ids) < max(1, 2000 // max(1, b.bucket_length)))
    assert all(n == 1 for n in full.values())
    assert packing.batches(docs(spark, texts).limit(0)).count() == 0


def test_batches_are_the_same_at_any_range_size(spark, monkeypatch):
    """Short texts, a few long ones and many equal rows: one batch a bucket at most is not full, over however many ranges."""
    rows = [(i, f"a{i} b c") for i in range(3000)] + [(i, "w " * 1000) for i in range(60)] + [(7, "same row here")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    for size in (32_000, 100):
        monkeypatch.setattr(packing, "RANGE_ROWS", size)
        made = packing.batches(df, buckets=2).select("bucket", "batch", "bucket_length", "doc_ids").collect()
        assert Counter(d for b in made for d in b.doc_ids) == Counter(i for i, _ in rows)
        for k, n, length in ((0, 3400, 3), (1, 60, 1000)):
            mine, room = sorted((b.batch, len(b.doc_ids)) for b in made if b.bucket == k), 16_384 // length
            assert [b for b, _ in mine] == list(range(-(-n // room))) and [m for _, m in mine] == [room] * (n // room) + [n % room] * (n % room > 0)
        seen.append(sorted((b.bucket, b.batch, sorted(b.doc_ids)) for b in made if b.bucket))
    assert seen[0] == seen[1]


def test_packing_keeps_rows_of_one_id(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "d e f"), (3, "d e f"), (3, None)], "doc_id long, text string").withColumn("row", F.lit(0)).withColumn("bucket", F.lit(9))
    got = packing.unpacked(packing.batches(rows, buckets=2)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter([(None, 2), (None, 1), (3, 3), (3, 3), (3, 0)])


def test_quality_network_learns_and_its_gradients_are_right():
    net = quality.new_network(0)
    x, h = quality.padded(b"The quick brown fox " * 60), 1e-2
    grads, loss = quality._gradients(net, x, 1.0, 1.0)
    for part, g in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = part[at]
        part[at] = old + h
        up = quality._gradients(net, x, 1.0, 1.0)[1]
        part[at] = old - h
        down = quality._gradients(net, x, 1.0, 1.0)[1]
        part[at] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g[at]), rel=0.2, abs=0.02)
    good = [(prose(s, 150).encode(), 1) for s in range(30)]
    bad = [(b"BUY NOW!! " * (40 + s), 0) for s in range(30)]
    trained = quality.train(good + bad, epochs=6)
    assert quality.probability(trained, prose(99, 400).encode()) > 0.5 > quality.probability(trained, b"BUY NOW!! " * 77)
    assert 0 <= quality.probability(trained, b"") <= 1


def test_samples_keep_to_their_bounds(spark):
    rows = [(1, f"text {k} {prose(k, 30)}", "en", None, k) for k in range(50)] + [(None, "nothing", "de", None, 1), (2, None, "en", None, 1), (3, "x", None, None, 1), (4, prose(2, 40_000), "fr", None, 1)]
    rows += [rows[0]] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, n int").withColumn("key", F.lit(1)).withColumn("l", F.lit("x"))
    found = language.learn_dictionaries(df, per_language=7, chunk_chars=64, chunks=20)
    assert set(found) == {"de", "en", "fr"} and all(len(v) <= 20 * 65 for v in found.values())
    held = " ".join(prose(2, 40_000).split())
    picked = found["fr"].decode().split("\n")
    assert all(p in held for p in picked) and max(held.index(p) for p in picked) > len(held) // 2
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    sample = quality.labelled_sample(df, labels, per_label=3)
    assert Counter(y for _, y in sample) == Counter({1: 3, 0: 2})
    long = max(sample, key=lambda s: len(s[0]))[0].decode()
    assert long == prose(2, 40_000)
    assert language.learn_dictionaries(df.limit(0)) == {} and quality.labelled_sample(df.limit(0), labels) == []


def test_a_tiny_language_leaves_the_others_dictionaries_alone(spark):
    rows = [(k, prose(k, 300), "en") for k in range(100)]
    alone = language.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    both = language.learn_dictionaries(spark.createDataFrame([*rows, (500, "kort", "nl")], "doc_id long, text string, lang string"))
    assert both["en"] == alone["en"] and len(both["en"]) > 50_000 and both["nl"].strip() == b"kort"


def test_texts_without_a_letter_are_unknown(spark):
    texts = ["²½①Ⅷ", "123 -- !", "_", "", None, "ª", "Ж", "漢"]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    found = {r.doc_id: r.lang_pred for r in language.identify(df, {"en": b"some english text"}, reject=False).collect()}
    assert [found[i] for i in range(8)] == ["und"] * 5 + ["en"] * 3


def test_long_texts_are_learned_in_stretches_like_whole():
    """Filters' tops over stretches are those of one pass, also beyond the first stretch."""
    net, half = quality.new_network(2), quality.CHUNK // 2
    x = quality.padded(prose(5, 9000).encode())
    assert len(x) > 2 * 64 * half * quality.STEP
    tops, where = quality._tops(net, x)
    _, out = quality._responses(net, x)
    cells = out.reshape(-1, half, quality.FILTERS)
    assert np.allclose(tops, cells.max(axis=1), atol=1e-5) and (where == cells.argmax(axis=1)).mean() > 0.999


def plain_probability(net, raw):
    """The network's score by loops: filters at every second byte, chunks of 256 positions, half overlapping."""
    positions = quality.CHUNK
    while positions < -(-len(raw) // quality.STEP):
        positions += quality.CHUNK // 2
    x = raw.ljust((positions + quality.TAPS - 1) * quality.STEP, b"\0")
    out = np.zeros((positions, quality.FILTERS))
    for p in range(positions):
        seen = np.concatenate([net.table[x[p * quality.STEP + k]] for k in range(quality.STEP * quality.TAPS)])
        out[p] = seen @ net.filters.reshape(-1, quality.FILTERS)
    logits = []
    for at in range(0, positions - quality.CHUNK + 1, quality.CHUNK // 2):
        logits.append(float(np.maximum(out[at : at + quality.CHUNK].max(axis=0) + net.bias, 0) @ net.dense))
    z = net.head[0] + net.head[1] * np.mean(logits) + net.head[2] * min(logits)
    return 1 / (1 + np.exp(-z))


def test_scores_match_a_plain_network(spark, texts):
    net = quality.new_network(3)
    short = [t if t is None or len(t) < 3000 else t[:3000] for t in texts] + [None]
    df = docs(spark, short).withColumn("score", F.lit(9.0)).withColumn("held_out", F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(df, net, {"doc_id": "long", "held_out": "boolean"}).collect()}
    assert got == {i: pytest.approx(plain_probability(net, (t or "").encode()), abs=1e-4) for i, t in enumerate(short)}
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert quality.score(rows, net, {"doc_id": "long"}).count() == 3


def plain_language(text, dictionaries):
    """The language whose dictionary compresses the text's pieces to the least."""
    raw, totals = text.lower().encode(), {}
    for name, content in dictionaries.items():
        tool = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
        totals[name] = sum(len(tool.compress(raw[i : i + language.PIECE])) for i in range(0, len(raw), language.PIECE))
    return min(sorted(totals), key=lambda k: totals[k])


def test_language_is_that_of_the_least_size(spark):
    r = np.random.default_rng(8)
    kinds = {"aa": ["ka", "lo", "mi", "pu"], "bb": ["ster", "und", "ich", "ach"]}
    made = [(i, " ".join("".join(r.choice(kinds[k], 3)) for _ in range(int(r.integers(1, 400)))), k) for i, k in enumerate(["aa", "bb"] * 30)]
    made += [(60, made[0][1] * 300, "aa"), (None, "ka lo", "aa"), (None, "ka lo", "aa"), (61, "", None), (62, None, "bb"), (63, "1 2 3", "bb")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "l": F.lit("q"), "score": F.lit(1.0), "held_out": F.lit(False)})
    found = language.learn_dictionaries(df.where("doc_id < 40"))
    got = language.identify(df, found, reject=False).collect()
    assert len(got) == len(made) and all(0 <= x.score <= 1 for x in got)
    want = Counter((i, plain_language(t, found) if re.search("[a-z]", t or "") else "und") for i, t, _ in made)
    assert Counter((x.doc_id, x.lang_pred) for x in got) == want
    assert language.identify(df.limit(0), found).count() == 0
    assert {x.lang_pred for x in language.identify(df, {}).collect()} == {"und"}


def test_chat_round_trip(spark):
    nasty = ["<|end|>", "a<\\|text|>", "", None, " lead and trail \n", r"\### Assistant: </turn> ok", "é<|turn|>ü", "<" * 5 + "|"]
    rows = [(c, k, "assistant" if k % 2 else "user", nasty[(c + k) % len(nasty)]) for c in range(6) for k in range(9)]
    rows += [(None, 0, "user", "of no"), (None, 1, "assistant", "conversation"), (None, 1, "assistant", "conversation"), (9, None, None, None), (10, 0, "assistant", prose(1, 50_000))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"mask": F.lit(1), "tokens": F.lit("x"), "starts": F.lit(2.0)})
    formatted = stored(chat.format_conversations(turns).repartition(5), "chat")
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {*range(6), None, 9, 10}
    for c in got:
        mine = [(role or "", t or "") for cc, _, role, t in rows if cc == c]
        shown = "".join(f"{role}\n{t}\n" for role, t in mine)
        loss = "".join(t for role, t in mine if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(shown.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.escape(role)) + len(chat.escape(t)) + len("".join(chat.CONTROL)) for role, t in mine)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_tokens_are_the_text_and_the_mask_is_the_spans(spark):
    turns = [("user", "What is <|end|>?"), ("assistant", "It's  an éscape, 12 of them."), ("assistant", "!!"), ("user", "ok")]
    text, spans = chat.render(turns, "assistant")
    ids, at = chat.encode(text, chat.TOKENIZER)
    encoder, _ = chat.tokenizer(chat.TOKENIZER)
    raw = text.encode()
    assert [encoder.decode_single_token_bytes(int(i)) for i in ids] == [raw[a:b] for a, b in itertools.pairwise(at.tolist())]
    inside = [any(a <= s < b for a, b in spans.tolist()) for s in at[:-1].tolist()]
    assert chat.token_mask(at[:-1], spans).tolist() == inside and sum(inside) > 5
    assert chat.masked_texts(raw, np.array(inside), at[:-1]) == [t for role, t in turns if role == "assistant"]


def test_empty_tables(spark, texts):
    none = docs(spark, texts).limit(0)
    for f in (lambda d: near_dedup.near_duplicates(d), exact_dedup.exact_duplicates, substring_dedup.repeated_passages, media.stored_media):
        assert f(none).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "x y z")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect())
    assert got == Counter([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (None, None, 1, True), (2, 2, 1, True)])
    assert {r.component_id for r in near_dedup.near_duplicates(rows, 3).collect() if r.n_shingles == 4} == {1}
    assert substring_dedup.repeated_passages(rows, 3).count() == 5


def test_many_rows_of_one_id_stay_apart(spark):
    texts = [prose(700 + k, 50) for k in range(40)]
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(texts)] + [(None, texts[0]), (7, texts[1]), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    exact = exact_dedup.exact_duplicates(df).collect()
    assert len(exact) == 43 and sum(r.kept for r in exact) == 40 and sum(r.group_size == 2 for r in exact) == 6
    near = near_dedup.near_duplicates(df, 3, 85).collect()
    assert len(near) == 43 and Counter(r.component_id for r in near)[7] == 23
    cut = substring_dedup.repeated_passages(df, 35).collect()
    assert len(cut) == 43 and sum(r.n_removed == 50 for r in cut) == 6 and sum(r.n_removed == 0 for r in cut) == 37


def test_fetch_brings_each_row_once(spark):
    df = documents(spark.createDataFrame([(None, f"t{k}") for k in range(500)], "doc_id long, text string"))
    assert fetch(df, stored(df.select("row"), "test"), ["text"]).count() == 500


def test_word_kernel_matches_split():
    raw = ["", "a", " b  c\t", "\x0b\x0c", "é ü\n" * 3, "x" * 5000 + " y"]
    (hashes, other), first = kernels.word_hashes([t.encode() for t in raw], lanes=2)
    assert not set(hashes.tolist()) & set(other.tolist())
    assert [int(b - a) for a, b in zip(first[:-1], first[1:], strict=True)] == [len(WORD.findall(t)) for t in raw]
    assert len(set(hashes.tolist())) == len({w for t in raw for w in WORD.findall(t)})
