"""Quality rules, chat formatting, language identification, url rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from stopwise.llm import chat_format, language_id, quality_rules, registry, url_filter
from tests.llm.helpers import words

DOCS = "doc_id long, text string, source string"


def base_figures(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    rng = random.Random(4)
    texts = [None, "", "\n \n", "one", "a b c a b c", "a a a a a", "x\ny\nx\n x", "é # é\n<b>&|$%*", " ".join(rng.choice("abcd") for _ in range(300))]
    texts += ["\n".join(" ".join(rng.choice(["p", "q", "r", "s", "t"]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 20000)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    for r in quality_rules.judged(df).collect():
        figures = base_figures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures
        assert r.base_failed == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
        assert not (r.base_failed and r.kept)


def test_boilerplate_lines_and_depleted_documents(spark):
    name = str.maketrans("0123456789", "abcdefghij")  # digits are all the same in a normalised line
    own = lambda i, n=60: " ".join(f"d{i}w{k}".translate(name) for k in range(n))
    rows = [(i, f"Call  US 0{i % 10}\n{own(i)}", "a") for i in range(40)]
    rows += [(100, "CALL us 07\n" * 30 + "and some more words here " + own(100, 10), "a"), (101, f"call us 05\n{own(101)}", "b")]
    rows += [(200 + i, own(200), "a") for i in range(60)]  # exact copies are one document
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].n_removed_words == 3 and got[i].kept and got[i].kept_text == own(i) for i in range(40))
    assert got[100].n_removed_words == 90 and not got[100].kept
    assert got[101].n_removed_words == 0 and got[101].kept
    assert all(got[200 + i].kept and got[200 + i].n_removed_words == 0 for i in range(60))


def test_lines_of_a_small_share_of_a_large_host(spark):
    name = str.maketrans("0123456789", "abcdefghij")
    own = lambda i, n=60: " ".join(f"d{i}w{k}".translate(name) for k in range(n))
    lines = {"All rights reserved by the owner": 300, "Read more on this page": 150, "Seen in less than one percent": 25}
    texts = ["\n".join([*(line for line, n in lines.items() if i < n), own(i)]) for i in range(3000)]
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(3000, "\n".join(["Read more on this page"] * 30 + [own(3000, 20)]), "h")]
    rows += [(4000, "Read more on this page\n" + own(4000), "other")]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    for i in range(3000):
        assert got[i].n_removed_words == 6 * (i < 300) + 5 * (i < 150)
        assert got[i].kept_text == ("Seen in less than one percent\n" if i < 25 else "") + own(i)
    assert got[3000].n_removed_words == 150 and got[3000].kept_text == own(3000, 20) and not got[3000].kept
    assert got[4000].n_removed_words == 0


def test_repeated_rows_and_empty_table(spark):
    text = "boiler plate\n" + " ".join(f"w{i}" for i in range(60))
    rows = [(i, text.replace("w0", f"v{i}"), "h") for i in range(30)] + [(3, text.replace("w0", "v3"), "h")]
    got = [r.n_removed_words for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).filter("doc_id = 3").collect()]
    assert got == [2, 2]
    assert quality_rules.judged(spark.createDataFrame([], DOCS)).count() == 0


CHAT = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|end|>", "<|start|>user<|text|>x<|end|>", "\\<|end|>\\", "<\\|end|>", "a\\\\b", "<", "|end|>", "[\\INST]", "<<SYS>>\n<</SYS>>", "", None, "<|start|>", "\\", "é<s>", "$1\\1"]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "be"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "assistant", "x"), (4, 5, None, "n"), (None, 0, "user", "u"), (6, 0, "<|end|>", "role")]
    df = spark.createDataFrame(rows, CHAT)
    marked = chat_format.formatted(df)
    got = {r.conv_id: r for r in chat_format.read_back(marked).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss_text == "".join(t or "" for t in NASTY[1::2])
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert got[1].formatted.count("<|end|>") == len(NASTY) and "[INST]" not in got[1].formatted
    assert got[6].turns[0].role == "<|end|>"
    assert (got[1].valid, got[2].valid, got[3].valid, got[4].valid) == (True, True, False, False)
    assert got[3].wrong_turn == 0 and got[2].wrong_turn is None and len(got) == 6
    assert chat_format.formatted(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_digests(spark):
    rows = [(7, 1, "assistant", "ä"), (7, 0, "user", "b"), (7, 1, "assistant", "ä")]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.with_probe(spark.createDataFrame(rows, CHAT))).collect()}
    assert got[7].turns_sha256 == hashlib.sha256("user\nb\nassistant\nä\nassistant\nä\n".encode()).hexdigest()
    assert (got[7].n_turns, got[7].loss_chars, got[7].loss_sha256) == (3, 2, hashlib.sha256("ää".encode()).hexdigest())
    said = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_sql(spark, sf_dir, name):
    base = duckdb.connect()
    for table in ("documents", "conversations", "pages", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = registry.all_queries()[name](spark, sf_dir)
    result = base.execute(registry.all_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(dict(zip(names, row))[c] for c in df.columns) for row in result.fetchall())
    assert Counter(map(tuple, df.collect())) == want


def test_languages(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = registry.op4_language_id(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(i, f"alpha beta gamma delta {i}", "aa") for i in range(40)] + [(100 + i, f"zürich öl über wasser {i}", "bb") for i in range(40)]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1003, "über öl wasser", None), (1004, "qq", None), (None, "alpha beta gamma", "bb"), (1005, "ALPHA BETA GAMMA " * 5000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predicted(df).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None, 1005)] == ["und", "und", "und", "bb", "aa", "aa", "aa"]
    assert got[1004].score == 0 and got[1000].score == 0 and not got[None].held_out
    bare = language_id.predicted(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")).collect()
    assert bare[0].lang_pred == "und" and language_id.predicted(df.limit(0)).count() == 0


def test_filters_lose_no_gram():
    rng = random.Random(1)
    members = [(rng.getrandbits(64) - (1 << 63), rng.randrange(10)) for _ in range(500)]
    table, false = language_id.build([str(i) for i in range(10)], members)
    for gram, lang in members:
        at = language_id.places(language_id.np.array([gram], "int64").view("uint64"))
        assert all(table[lang // 8, p[0]] >> (lang % 8) & 1 for p in at)
    assert (false < 1e-6).all()


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12", "https://example.org/en/2", "http://org/x", "http://notorg/", "http://x.org", "ftp://b.com/fr/", "http://b.com/de/?q=/fr/", "http://user@b.com:80/de/1", "no scheme", None, "", "http://b.net/a?x://y", "http://B.net#f", "x://y://z/", "http://b.com/DE/1"]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("org", "/x", "org/", "allow"), ("notorg", "/", None, "allow"), ("x.org", "", None, "allow"),
            ("b.com", "/fr/", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"), ("user@b.com:80", "/de/1", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.net", "/a", None, "allow"), ("b.net", "", None, "allow"), ("y:", "//z/", None, "allow"), ("b.com", "/DE/1", None, "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == want


def test_trees_learn_from_labels(spark):
    rows = [(i, f"http://{'casino' if i % 3 == 0 else 'news'}{i % 7}-{'win' if i % 3 == 0 else 'site'}.example.net/{'a/' * (i % 4)}{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    label = url_filter.F.when(url_filter.F.col("host").contains("casino"), 1).otherwise(0)
    got = url_filter.judged(df, [], label).collect()
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got) >= 285
    assert url_filter.judged(df.limit(0)).count() == 0


def test_trees_judge_hosts_without_labels(spark):
    """Half of the hosts give labels; on the others most of what is to be blocked is found, and little else."""
    df = registry.table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    seen = url_filter.F.pmod(url_filter.F.crc32(url_filter.F.col("host").cast("binary")), url_filter.F.lit(2)) == 0
    truth = url_filter.weak_labels(df)
    rows = url_filter.judged(df, [], url_filter.F.when(seen, truth)).select(truth.alias("truth"), "verdict").filter(~seen).collect()
    hits = sum(r.truth and r.verdict == "block" for r in rows)
    assert sum(r.truth for r in rows) >= 5 and hits >= 0.8 * sum(r.truth for r in rows) and hits >= 0.8 * sum(r.verdict == "block" for r in rows)


def test_no_rate_holds_the_label_of_its_host(spark):
    """All labels of a host turned round change nothing in its own rates."""
    urls = [(f"http://{h}.example.{t}/{i}", f"{h}.example.{t}", f"/{i}", label) for h, t, label in (("a", "net", 1), ("b", "net", 0), ("c", "org", 1), ("d", "net", 1)) for i in range(5)]
    rates = []
    for turn in (0, 1):
        sample = spark.createDataFrame([(u, h, p, 1 - x if turn and h == "a.example.net" else x) for u, h, p, x in urls], "url string, host string, path string, label int")
        smoothed = url_filter.with_rates(sample, sample).filter("host = 'a.example.net'").select("rate1", "rate2", "rate3").distinct().collect()
        overall = sample.agg(url_filter.F.avg("label")).first()[0]
        assert len(smoothed) == 1 and smoothed[0].rate3 == pytest.approx(overall)
        rates.append(smoothed[0].rate1 * (10 + url_filter.SMOOTHING) - url_filter.SMOOTHING * overall)
    assert rates[0] == pytest.approx(rates[1]) == pytest.approx(5)


def test_copies_of_a_url_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TRAINING_ROWS", 40)
    urls = [f"http://{'casino' if i % 2 else 'news'}{i}.example.net/" for i in range(60)]
    # The url that comes first in the sample has most of the rows.
    first = spark.createDataFrame([(u,) for u in urls], "url string").orderBy(url_filter.F.xxhash64("url")).first().url
    rows = list(enumerate(urls)) + [(100 + i, first) for i in range(100)] + [(100, first)] * 50
    df = url_filter.ruled(url_filter.parsed(spark.createDataFrame(rows, "page_id long, url string")))
    sample = url_filter.training_sample(df, url_filter.F.col("host").contains("casino").cast("int")).collect()
    assert len({r.url for r in sample}) == len(sample) == 40 and {r.label for r in sample} == {0, 1}
