import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stopwise.llm import components, near_dedup, registry, substring_dedup, suffix_dedup
from stopwise.llm import superkmers as sk
from stopwise.llm import vectors as v
from tests.llm import helpers

SCHEMA = "doc_id long, text string"


def texts(seed, count, alphabet=40, longest=120):
    """Random texts over few words, with passages copied between them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(alphabet)]
    bodies = []
    for _ in range(count):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, longest))]
        for _ in range(rng.randint(0, 2)):
            if bodies:
                other = rng.choice(bodies)
                at = rng.randint(0, len(other))
                body[rng.randint(0, len(body)) : 0] = other[at : at + rng.randint(0, 80)]
        bodies.append(body)
    return [rng.choice([" ", "\n", " \t "]).join(body) for body in bodies]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, one very long word, periodic text, repeated texts, odd columns."""
    rows = list(enumerate([None, "", " \n\t", "x" * 5000, "ab " * 400, "ab " * 400, "é" * 300, "y", *texts(1, 30), *texts(1, 6)]))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("window", [1, 5, 35])
def test_substrings(odd, window):
    rows, df = odd
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, window).collect()}
    for (key, text), kept in zip(rows, helpers.kept_words([t for _, t in rows], window)):
        assert (got[key].n_words, got[key].n_removed, got[key].kept_text) == (len(helpers.words(text)), len(helpers.words(text)) - len(kept), " ".join(kept))


def test_substrings_in_their_own_spacing(odd):
    rows, df = odd
    for r, kept in zip(sorted(substring_dedup.remove_repeats(df, 5, spacing=True).collect(), key=lambda r: r.doc_id), helpers.kept_words([t for _, t in rows], 5)):
        assert helpers.words(r.kept_text) == kept
        assert r.n_removed or r.kept_text == (rows[r.doc_id][1] or "")


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 7, "a"), (1, text, 7, "b"), (None, text + " more", 8, "c"), (2, "short", 9, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    got = {r["row"]["row"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert [got[k].n_removed for k in "abcd"] == [50, 50, 50, 0] and got["c"].kept_text == "more" and got["a"]["row"]["n_words"] == 7
    late = {r["row"]["row"]: r.n_removed for r in suffix_dedup.remove_later_copies(df).collect()}
    # A null id is ordered as 0; repeated rows are one document.
    assert late["c"] == 0 and late["a"] == late["b"] == len(text) and late["d"] == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(df).count() == 0
    assert suffix_dedup.remove_later_copies(df).count() == 0
    assert near_dedup.near_copies(df).count() == 0


@pytest.mark.parametrize("window", [20, 35, 100])
def test_bytes(odd, window):
    rows, df = odd
    want = helpers.later_bytes(rows, window)
    for r in suffix_dedup.remove_later_copies(df, window).collect():
        data, gone = (rows[r.doc_id][1] or "").encode(), want[r.doc_id]
        runs = [x for x in gone.split(b"\0") if x]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(gone), len(runs))
        assert r.kept == bytes(x for x, g in zip(data, gone) if not g)
        assert [s.end - s.begin for s in r.spans] == [len(x) for x in runs]


def test_hot_grams_change_nothing(odd, monkeypatch):
    rows, df = odd
    want = sorted(substring_dedup.remove_repeats(df, 5).select("doc_id", "n_removed").collect())
    grams = [substring_dedup.word_tokens(*v.utf8(pa.array([text or ""])), 4).grams for _, text in rows]
    hot = np.unique(np.concatenate(grams))[::2]
    monkeypatch.setattr(sk, "frequent_grams", lambda docs, scheme: hot)
    assert sorted(substring_dedup.remove_repeats(df, 5).select("doc_id", "n_removed").collect()) == want


def test_frequent_grams(spark):
    common = " ".join(f"c{i}" for i in range(400))
    df = spark.createDataFrame([(i, f"{common} u{i}") for i in range(40)], SCHEMA).coalesce(1)
    plan = substring_dedup.scheme(35)
    found = sk.frequent_grams(sk.keyed(df), plan)
    every = np.unique(substring_dedup.word_tokens(*v.utf8(pa.array([common])), 4).grams)
    assert set(found.tolist()) == {g for g in every.tolist() if g < (1 << 64) // plan.rare}


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(3, 20))]
    df = spark.createDataFrame(rows, SCHEMA)
    packed = sk.pack(sk.keyed(df), substring_dedup.scheme(5), frequent := sk.frequent_grams(sk.keyed(df), substring_dedup.scheme(5)))
    blobs = [bytes(r.blob) for r in packed.filter("kind = 1").collect()]
    bucket = sk.unpack(blobs)
    want = [x.tolist() for x in substring_dedup.repeated_windows(bucket, 5)]
    monkeypatch.setattr(substring_dedup.v, "mix", lambda x: x & x.dtype.type(7))
    got = [x.tolist() for x in substring_dedup.repeated_windows(bucket, 5)]
    assert got == want and frequent is not None


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies(spark, odd, size):
    rows = [*odd[0], *[(1000 + i, t) for i, t in enumerate(edited(5, 60))]]
    want = helpers.groups(rows, size)
    got = near_dedup.near_copies(spark.createDataFrame(rows, SCHEMA), size).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(helpers.shingles(dict(rows)[r.doc_id], size)) and r.kept == (r.component_id == r.doc_id) for r in got)


def edited(seed, count):
    """Copies of three texts with a few words changed, at similarities on both sides of the limit."""
    rng = random.Random(seed)
    base = [[f"t{k}-{i}" for i in range(100 + 40 * k)] for k in range(3)]
    out = []
    for i in range(count):
        body = list(base[i % 3])
        for _ in range(rng.randint(0, 9)):
            body[rng.randrange(len(body))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(body))
    return out


def test_blocks_close_what_stars_leave_open(spark, monkeypatch):
    """A bucket far larger than a block, compared block by block."""
    rows = list(enumerate(edited(9, 90)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = near_dedup.near_copies(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == helpers.groups(rows, 2)


def test_copies_null_ids_and_tiny_sets(spark):
    rows = [(5, "a b c"), (3, "A B  C"), (None, "a b c"), (9, "one"), (8, "ONE"), (7, None), (6, " "), (7, None)]
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 3, False), (3, 3, True), (0, 3, False), (9, 8, False), (8, 8, True), (7, 7, True), (6, 6, True), (7, 7, True)], key=str)


def test_queries_on_given_data(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = helpers.kept_words([t for _, t in rows], 35)
    got = {r.doc_id: r.kept_sha256 for r in registry.op1_substring_dedup(spark, sf_dir).collect()}
    assert got == {key: hashlib.sha256(" ".join(k).encode()).hexdigest() for (key, _), k in zip(rows, kept)}
    gone = helpers.later_bytes(rows, 100)
    got = {r.doc_id: r.kept_sha256 for r in registry.op9_suffix_dedup(spark, sf_dir).collect()}
    assert got == {key: hashlib.sha256(bytes(x for x, g in zip((t or "").encode(), gone[key]) if not g)).hexdigest() for key, t in rows}
    assert {r.doc_id: r.component_id for r in registry.op6_near_dedup(spark, sf_dir).collect()} == helpers.groups(rows, 2)


def test_copies_of_a_row_do_not_multiply_its_spans(spark):
    """A text of which there are many equal rows carries as many spans as one of which there are two."""
    text = " ".join(f"w{i}" for i in range(60))
    for copies in (2, 500):
        rows = spark.createDataFrame([(7, text)] * copies + [(8, text)], "doc_id long, text string").repartition(4)
        plan, keyed = substring_dedup.scheme(35), sk.keyed(rows)
        spans = sk.repeated_spans(sk.pack(keyed, plan, sk.frequent_grams(keyed, plan)), lambda bucket: substring_dedup.repeated_windows(bucket, 35))
        lengths = sk.with_spans(rows, spans).selectExpr("size(_spans) as n").collect()
        assert len(lengths) == copies + 1 and max(r.n for r in lengths) <= 10


def test_copies_of_a_crowded_set_go_to_several_tasks(spark):
    rows = [(i, "one text that a third of all rows hold") for i in range(300)] + [(1000 + i, f"other text number {i} with words of its own {i}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sets = near_dedup.sets_of_documents(df, 2)
    classes = sets.groupBy("set_key").agg(near_dedup.F.count("*").alias("copies"))
    many = near_dedup.crowded(classes).collect()
    assert len(many) == 1 and many[0]._pieces >= 4
    got = {r.doc_id: r for r in near_dedup.near_copies(df).collect()}
    label = helpers.groups(rows[:1] + rows[300:340], 2)
    assert {got[i].component_id for i in range(300)} == {0} and [i for i in range(300) if got[i].kept] == [0]
    assert all(got[k].component_id == v for k, v in label.items()) and len(got) == 900


def test_links_of_near_copies_are_thinned(spark):
    """Nodes linked with up to 40 centres each: the rounds must not join all those links, and lose none of them."""
    rng = random.Random(5)
    links = [(c, 1000 * group + n) for group in (1, 2) for n in range(100, 700) for c in rng.sample(range(1000 * group, 1000 * group + 60), 40)]
    links += [(b, a) for a, b in links[::7]] + [(5000 + i, 5001 + i) for i in range(30)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {n for link in links for n in link}
    assert components.thinned(components.thinned(df)).count() < 1.1 * len(nodes)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {n: 1000 if n < 2000 else 2000 if n < 5000 else 5000 for n in nodes}
