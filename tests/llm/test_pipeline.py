"""The corpus pipeline's stages against brute force, each over all that its predecessor kept."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from voxloom.llm import packing, quality
from voxloom.llm.storage import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, kept boolean, size long, score double"


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "pu", "ten"], 3)) + "." * (k % 9 == 0) for k in range(n))


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    texts = [prose(s, 60 + s) for s in range(30)]
    near = [t.replace(t.split()[30], "new", 1) for t in texts[:6]]
    odd = [None, "", " ", "one", prose(99, 9000)]
    junk = [f"BUY NOW {k}!!! $$$ " * 25 for k in range(30)]
    rows = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3], len(t or ""), 1, True, 2, 0.5) for i, t in enumerate(texts + junk + texts[:4] + near + odd)]
    rows += [(None, prose(200, 70), None, None, None, None, None, None, None), rows[2]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top)


@pytest.fixture(scope="module")
def states(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test")
        out.append(docs.collect())
    return out


def test_stages_but_the_last_return_the_columns_of_documents(states):
    assert all(set(r.asDict()) == set(corpus_pipeline.COLUMNS) for part in states[1:5] for r in part)
    assert sum(len(r.doc_ids) for r in states[5]) == len(states[4]) > 0


def test_classifier_drops_junk_and_keeps_prose(spark, sf_dir, states):
    before, after = states[0], states[1]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = docs.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 <> 1")
    net = quality.train(quality.labelled_sample(learned, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = Counter((r.doc_id, r.text) for r in before if quality.probability(net, (r.text or "").encode()) >= 0.5)
    assert Counter((r.doc_id, r.text) for r in after) == want
    ids = {r.doc_id for r in after}
    assert set(range(30)) <= ids and not ids & set(range(30, 60))


def test_exact_copies_leave_the_smallest_id(states):
    groups = defaultdict(list)
    for r in states[1]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = Counter(min(g, key=lambda i: (i is None, i)) for g in groups.values())
    assert Counter(r.doc_id for r in states[2]) == want


def test_near_copies_leave_one_document_of_each_class(states):
    rows = states[2]
    sets = []
    for r in rows:
        w = words((r.text or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[root[i]].append(r.doc_id)
    want = Counter(min(g, key=lambda i: (i is None, i or 0)) for g in classes.values())
    assert Counter(r.doc_id for r in states[3]) == want
    assert len(states[3]) < len(rows)


def test_dedup_stages_decide_by_row_not_by_id(spark):
    texts = [prose(300 + k, 60) for k in range(8)]
    near = texts[6].replace(texts[6].split()[30], "new", 1)
    # Nulls with distinct texts, one id with two texts, one id with a copy and a text of its own, and a near copy alike.
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (9, texts[5]), (9, texts[7]), (None, texts[0]), (10, texts[6]), (None, near)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = stored(corpus_pipeline.drop_exact_copies(spark, docs, ""), "test")
    want = Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (9, texts[7]), (10, texts[6]), (None, near)])
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == want
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, exact, "").collect())
    assert left == want - Counter([(None, near)])


def test_mix_repeats_whole_documents_up_to_the_targets(states):
    rows = states[3]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    want = Counter()
    for s in names:
        budget, at = int(target[s]), 0
        mine = [r for r in rows if r.source == s]
        key = lambda r: hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()
        for r in sorted(mine, key=key):
            n = len(words(r.text))
            epochs = budget // sizes[s] if sizes[s] else 0
            taken = epochs * n + max(0, min(n, budget - epochs * sizes[s] - at))
            at += n
            want[r.doc_id] += int(taken / n + 0.5) if n else 0
    assert Counter(r.doc_id for r in states[4]) == +want


def test_packing_is_of_least_padding_and_within_budget(states):
    got, lengths = states[5], [len(words(r.text)) for r in states[4]]
    assert Counter((i, n) for r in got for i, n in zip(r.doc_ids, r.lengths, strict=True)) == Counter((r.doc_id, len(words(r.text))) for r in states[4])
    count = Counter(lengths)
    bounds = packing.bucket_bounds(np.array(sorted(count)), np.array([count[n] for n in sorted(count)]), 16)
    assert all(r.bucket_length == min(b for b in bounds if b >= n) for r in got for n in r.lengths)
    assert all(len(r.tokens) == len(r.doc_ids) * r.bucket_length and (len(r.doc_ids) == 1 or len(r.tokens) <= 16_384) for r in got)


def test_empty_tables_pass_through(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
