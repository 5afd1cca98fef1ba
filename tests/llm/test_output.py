"""Packing, archives, decontamination, the pipeline."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stopwise.llm import decontaminate, packing, warc
from tests.llm import helpers

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_fast_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(3)
    letters = [chr(i) for i in (*range(0x250), *range(0x2000, 0x2030), 0x1F600, 0x200D, 0xFEFF, 0x4E00, 0xAC00, 0x300)]
    texts = ["".join(rng.choice(letters if rng.random() < 0.5 else " \n'sabtA1.") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " " * 30000, "a" * 20000, "x" + "\n" * 9000 + "y", "<|endoftext|>a<|endoftext|>", "it's we'll \u00a0\u2003 x"]
    for text in texts:
        assert packing.encoder().ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "γ"]) for _ in range(rng.choice([0, 1, 5, 300, 1500, 9000])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "same"), (102, "same"), (None, "null id")]
    got = packing.packed(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    check_sequences(got)
    want = Counter()
    for key, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        want[key, len(ids)] += len(ids)
    have = Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == want
    texts = dict(rows)
    for r in got:
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], np.uint32)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def check_sequences(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_closest(seed):
    rng = random.Random(seed)
    capacity = rng.randint(1, 40)
    counts = [0] + [rng.choice([0, 0, 1, 2, 5]) for _ in range(45)]
    reach = {0}
    for length, n in enumerate(counts):
        for _ in range(n):
            reach |= {r + length for r in reach if r + length <= capacity}
    picked = packing.fill(capacity, counts)
    used = Counter()
    for length, n in picked:
        used[length] += n
    assert sum(length * n for length, n in picked) == max(reach) and all(n <= counts[length] for length, n in used.items())


def pages():
    big = "<p>" + "x" * 300000
    rows = [(i, f"http://h/{i}", f"<html>{i % 40}é</html>" if i % 3 else f"<b>{i}") for i in range(200)]
    rows += [(500, None, None), (501, "http://a b\n/é", ""), (502, "u", big), (503, "u", big), (502, "u", big), (None, "n", "only"), (None, "n", "<b>3")]
    random.Random(1).shuffle(rows)
    return rows


def test_archives(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/out"
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shards=3, roll=4000).collect()
    got = warc.read(spark, folder).collect()
    first = {}
    for key, _, html in rows:
        html = html or ""
        first[html] = min(first.get(html, float("inf")), float("inf") if key is None else key)
    assert sum(m.records for m in manifest) == len(rows) == len(got) and len(manifest) > 3
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((k, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for k, _, h in rows)
    assert Counter(r.payload_digest for r in got if r.record_type == "response") == Counter({d: 1 for d in {r.payload_digest for r in got}})
    texts = {(k, hashlib.sha1((h or "").encode()).digest()): h or "" for k, _, h in rows}
    for r in got:
        own = first[texts[r.page_id, base64.b32decode(r.payload_digest)]]
        if r.record_type == "revisit":
            assert r.refers_to == own and r.payload is None
        else:
            assert r.refers_to is None and (r.page_id == own or own == float("inf"))
    # A standard reader of members finds whole records in the files, in order of their pages.
    for m in manifest:
        data = (tmp_path / "out" / m.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == m.sha256 and len(data) == m.bytes
        assert len(re.findall(rb"^WARC/1.1\r$", gzip.decompress(data), re.M)) == m.records + 1
    assert not list((tmp_path / "out" / "_attempts").iterdir())


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_archives_are_the_same_each_time(spark, tmp_path, shards):
    """However the rows are dealt out: the shards, and the bytes in them."""
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumns({"_shard": F.lit(9), "_order": F.lit("x")})
    runs = [sorted(map(tuple, warc.write(df.repartition(n), f"file://{tmp_path}/{n}", shards=shards).collect())) for n in (2, 5, 1)]
    assert runs[0] == runs[1] == runs[2] and len({row[1] for row in runs[0]}) == shards
    empty = f"file://{tmp_path}/empty"
    warc.write(df.limit(0), empty, shards=2)
    assert warc.read(spark, empty).count() == 0


@pytest.mark.parametrize("ids", [range(1000), [0] * 500 + list(range(500)), [-(1 << 63), (1 << 63) - 1, *range(7, 400)], [None] * 20, [3]])
def test_shard_bounds(spark, ids):
    """About equal numbers of pages, unless one id has more; ids may lie as far apart as they can."""
    df = spark.createDataFrame([(i,) for i in ids], "page_id long")
    edges = warc.bounds(df, 4)
    known = sorted(i for i in ids if i is not None)
    assert edges == sorted(edges) and len(edges) <= 3
    sizes = Counter(sum(e <= i for e in edges) for i in known)
    most = max(Counter(known).values(), default=0)
    assert max(sizes.values(), default=0) <= len(known) / 4 * 1.1 + most + 1


def test_pages_without_an_id_are_spread(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", f"page {i % 90}") for i in range(300)], "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}/n", shards=3).collect()
    assert len({m.shard for m in manifest}) == 3 and sum(m.records for m in manifest) == 300
    assert Counter(r.record_type for r in warc.read(spark, f"file://{tmp_path}/n").collect()) == {"response": 90, "revisit": 210}


def test_broken_archives_are_refused(spark, tmp_path):
    record = warc.page_record(1, "u", b"payload", False, None, 0)
    text = gzip.decompress(record)
    assert warc.parsed(text)[0] == 1
    with pytest.raises(ValueError):
        warc.parsed(text.replace(b"payload", b"paylOad"))


ITEMS = ["What is the tall red tower made of? It is made of forty thousand iron nails.", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "two words", None, ""]


def test_decontamination(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))
    rows = [
        (0, filler(300)), (1, f"{filler(200)} {ITEMS[0]} {filler(90)}"), (2, f"{filler(63)}\n{ITEMS[1].upper()}!"), (3, "What is the tall red tower made of? " + filler(100)),
        (4, "alpha, beta; gamma - delta. epsilon zeta eta theta iota X lambda mu"), (5, None), (6, ""), (7, f"{filler(40)} Two, words {filler(5)}"), (1, f"{ITEMS[0]}"),
    ]
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    docs = spark.createDataFrame([(*r, "s") for r in rows], f"{DOCS}, item_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    # 3 has the question without its answer; 4 has one word changed in a long item.
    assert {(1, 0), (2, 1), (7, 2)} <= got and not {i for i, _ in got} & {0, 3, 5, 6}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in {i for i, _ in got})
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows) and decontaminate.matches(docs.limit(0), bench).count() == 0


def index_of(items):
    """An index of (id, text) rows, with counts over just these."""
    words = decontaminate.cut([t for _, t in items])
    hashes, found = words.hashes(), []
    for (key, text), a, z in zip(items, words.first[:-1], words.first[1:]):
        terms, counts = np.unique(hashes[a:z], return_counts=True)
        found.append(decontaminate.Item(key, text, int(z - a), terms, counts.astype(float), terms))
    often = Counter(t for x in found for t in x.terms.tolist())
    for x in found:
        x.frequency = np.array([often[t] for t in x.terms.tolist()], float)
    return decontaminate.build(found, len(found), len(hashes) / len(found))


PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_matches(docs, items):
    """Every item with every passage of every document, scored and verified in plain Python."""
    cut = lambda t: PLAIN_WORD.findall(t.lower())
    shingles = lambda w: {tuple(w[i : i + k]) for k in [min(4, len(w))] if k for i in range(len(w) - k + 1)}
    overlap = lambda wanted, held: len(wanted & held) / len(wanted) if wanted else 1.0
    items = [(k, t, cut(t)) for k, t in {(k, t) for k, t in items if t} if cut(t)]
    often = Counter(w for _, _, own in items for w in set(own))
    mean = sum(len(own) for _, _, own in items) / max(len(items), 1)
    found = Counter()
    for doc, text in docs:
        words = cut(text or "")
        for key, whole, own in items:
            counts = Counter(own)
            part = {w: math.log(1 + (len(items) - often[w] + 0.5) / (often[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, c in counts.items()}
            size = 128
            while size < 2 * len(own):
                size *= 2
            ends = list(decontaminate.SENTENCE.finditer(whole.strip()))
            at = ends[-1].end() if ends else len(whole.strip())
            question, answer = cut(whole.strip()[:at]), cut(whole.strip()[at:])
            for start in range(0, max(len(words) - size // 2, 1) if words else 0, size // 2):
                passage = words[start : start + size]
                held = {tuple(passage[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(passage) - k + 1)}
                if sum(part[w] for w in counts.keys() & set(passage)) < 0.5 * sum(part.values()) - 1e-9:
                    continue
                fits = overlap(shingles(question), held) >= 0.6 and overlap(shingles(answer), held) >= 0.6
                if fits or 0 < len(answer) < 8 and overlap(shingles(own), held) >= 0.6:
                    found[doc, key] += 1
    return found


def decontamination_case(seed):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(4000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, f"{some(rng.randint(1, 30))}? {some(rng.randint(1, 12))}.") for i in range(60)] + [(60, some(180)), (61, None), (62, ""), (63, "?!"), (3, "same id"), (None, some(20)), (64, some(25)), (65, "w1 w1 w1")]
    items.append(items[5])
    docs = []
    for d in range(60):
        body = [some(rng.randint(0, 150))]
        for _, text in rng.sample(items, 2):
            own = (text or "").split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                if own:
                    own[rng.randrange(len(own))] = "edit"
            body += [" ".join(own), some(rng.randint(0, 90))]
        docs.append((d, " ".join(body)))
    return docs + [(100, None), (101, ""), (1, docs[1][1])], items


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_against_every_item_and_passage(spark, monkeypatch, seed):
    docs, items = decontamination_case(seed)
    want = plain_matches(docs, items)
    df, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 40
    runs = []
    for size, pairs in ((1 << 20, 1 << 21), (600, 50)):  # blocks and slices change nothing
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert (len(decontaminate.indexes_of(bench)) > 3) == (size == 600)
        rows = decontaminate.matches(df, bench).collect()
        assert {(r.doc_id, r.item_id): r.n_passages for r in rows} == want
        runs.append(sorted((r.doc_id, r.item_id or -1, r.begin, r.end, round(r.score, 9)) for r in rows))
    assert runs[0] == runs[1]


def test_many_items_cost_little_more_than_few():
    """Random items by the law of Zipf: the filter leaves few passages to query, whatever the number of items."""
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(f"z{w}" for w in np.minimum(rng.zipf(1.3, n), 20_000))
    batch = decontaminate.pa.record_batch([decontaminate.pa.array([text(400) for _ in range(40)])], ["text"])
    took = []
    for many in (50, 1000):
        index = index_of([(i, text(40)) for i in range(many)])
        start = time.perf_counter()
        decontaminate.matches_of(batch, index)
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0] + 2


def test_edits_in_short_answers():
    rng = random.Random(6)
    filler = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))
    question = "Which of the old harbour towns on the northern coast was the first one to build a stone light house?"
    items = [(0, f"{question} It was red Falmar."), (1, f"{filler(12)}? Yes."), (2, f"{filler(14)}. It is made of forty thousand iron nails, they say.")]
    index = index_of(items)
    texts = [f"{filler(90)} {question} It was blue Falmar. {filler(60)}", f"{question} It was Falmar.", items[1][1].replace("Yes", "No"), items[2][1].split(".")[0], "Which of the old harbour towns? It was red Falmar.", filler(200), items[0][1]]
    batch = decontaminate.pa.record_batch([decontaminate.pa.array(texts)], ["text"])
    # A long answer must be there itself; a few words of the question are not enough.
    assert {(row, item) for row, item, *_ in decontaminate.matches_of(batch, index)} == {(0, 0), (1, 0), (2, 1), (6, 0)}


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_what_scoring_all_items_finds(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(decontaminate, "POSTINGS", 3)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(120)]
    index = index_of(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 25)))
        scores = defaultdict(float)
        for t in terms:
            for p in range(index.offsets[t], index.offsets[t + 1]):
                scores[int(index.item[p])] += index.score[p]
        want = {i for i, s in scores.items() if s >= index.threshold[i] + 1e-9}
        maybe = {i for i, s in scores.items() if s >= index.threshold[i] - 1e-9}
        assert want <= {i for i, _ in decontaminate.search(index, terms, index.least)} <= maybe


def test_items_in_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(5)]
    docs = spark.createDataFrame([(i, f"pad pad {t} pad") for i, t in items] + [(9, "clean text")], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [9]


def plain_quality(rows, min_documents=20, min_share=0.01, min_left=0.3):
    """Kept texts of the first stage, in plain Python: (doc_id, text, source) rows with known texts."""
    lines = lambda t: [x for x in (t or "").split("\n") if helpers.words(x)]
    normal = lambda x: re.sub(r"[1-9]", "0", " ".join(helpers.words(x)).translate(helpers.LOWER))
    texts_of, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host or ""].add(text)
        for x in lines(text):
            texts_of[host or "", normal(x)].add(text)
    out = {}
    for key, text, host in rows:
        w = helpers.words(text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        often = lambda x: len(texts_of[host or "", normal(x)]) > max(min_documents, min_share * len(hosts[host or ""]))
        lost = sum(len(helpers.words(x)) for x in lines(text) if often(x))
        if len(w) >= 50 and 2 * len(repeated) <= len(w) and len(w) - lost >= min_left * len(w):
            out[key] = "\n".join(x for x in text.split("\n") if not (helpers.words(x) and often(x))) if lost else text
    return out


def test_first_and_fourth_stage_against_plain_versions(spark, tmp_path):
    rng = random.Random(11)
    some = lambda n: " ".join(f"q{rng.randint(0, 9000)}" for _ in range(n))
    shared = "Copyright 2024 by the Example  Press, all rights reserved 17"
    items = [(i, f"{some(20)}? {some(9)}.") for i in range(6)]
    rows = []
    for i in range(60):
        lines = [some(25), some(40)]
        if i % 2:
            lines.insert(1, shared.replace("17", str(10 + i % 80)))  # the same line but for its digits
        if i % 10 == 3:
            lines = [shared] * 6 + [some(4)]  # hardly anything else
        if i % 12 == 5:
            lines.append(items[i % 6][1])
        if i % 15 == 7:
            lines = [" ".join(["again and again"] * 30)]
        if i % 20 == 9:
            lines = [some(12)]
        rows.append((i, "\n".join(lines), ("s", "t")[i % 31 == 30]))
    docs = spark.createDataFrame([(k, t, "en", h, len(t)) for k, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = {r.doc_id: r.text for r in stages["quality_rules"](spark, docs, str(tmp_path)).collect()}
    assert good == plain_quality(rows) and len(good) < len(rows) - 6
    assert any(good[k] != t for k, t, _ in rows if k in good) and not any("Example" in t for k, t in good.items() if rows[k][2] == "s")
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()}
    leaks = {k for k, _ in plain_matches([(k, t) for k, t, _ in rows], items)}
    assert clean == {k for k, _, _ in rows} - leaks and len(leaks) >= 4


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: corpus_pipeline.stored(stages[name](spark, df, sf_dir), name)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = run("quality_rules", docs)
    assert good.dtypes == docs.dtypes and set(texts(good)) <= set(texts(docs))
    before = texts(good)
    unique = run("near_dedup", good)
    label = helpers.groups(list(before.items()), 5)
    assert texts(unique) == {k: t for k, t in before.items() if label[k] == k}
    cut = run("substring_dedup", unique)
    before, after = texts(unique), texts(cut)
    assert [helpers.words(after[k]) for k in before] == helpers.kept_words(before.values(), 35)
    assert cut.filter("n_chars <> length(text)").count() == 0 and cut.columns == docs.columns
    clean = run("decontamination", cut)
    gone = {r.doc_id for r in decontaminate.matches(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert texts(clean) == {k: t for k, t in after.items() if k not in gone}
    last = stages["packing"](spark, clean, sf_dir).collect()
    check_sequences(last)
    assert {r.doc_id for r in last} == set(texts(clean))
    assert Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, sf_dir).collect()).keys() and corpus_pipeline.ORACLE_SQL is None


def test_one_of_each_group_of_near_copies_stays(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{i}" for i in range(80))
    rows = [(None, text("n")), (None, text("n") + " end"), (None, "start " + text("n")), (7, text("a")), (7, text("a") + " end"), (7, text("b")), (8, text("b")), (None, text("c")), (9, text("c") + " end"), (10, ""), (None, None), (11, text("d"))]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    group = lambda t: t.split("start ")[-1][:1]
    assert sorted(group(r.text or "") for r in got) == ["", "", "a", "b", "c", "d", "n"]
    assert {(r.doc_id, r.text[0]) for r in got if r.text} >= {(7, "a"), (7, "b"), (9, "c"), (11, "d")}


def test_pipeline_with_nulls_and_extra_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "en", "s", 5, "x"), (1, long, "en", "s", 5, "x"), (2, None, None, None, None, None), (None, long + " end", "en", "s", 3, "y"), (3, "", "en", "s", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame([(0, "no such thing here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    # The null id and its longer text are near copies of 1; of the repeated row one is left.
    assert [(r.doc_id, r.kept) for r in docs.collect()] == [(1, "x")]


def test_every_stage_keeps_columns_with_clashing_names(spark, tmp_path):
    """Names that the operators use themselves, as the input's own columns."""
    names = ["_id", "_print", "_text", "_host", "_hash", "_spans", "_row", "row", "n", "set_key", "kept", "kept_text", "n_words"]
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(90))
    shared = text()
    bodies = [text() for _ in range(6)] + [f"{text()} {shared}", f"{text()} {shared}"]
    rows = [(i, body, "en", "s", len(body), *[f"{name}-{i}" for name in names]) for i, body in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(0, bodies[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert all(r[n] == f"{n}-{r.doc_id}" for r in docs.collect() for n in names), name
    assert {r.doc_id for r in docs.collect()} == {0, 1, 2, 3, 4, 6, 7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
