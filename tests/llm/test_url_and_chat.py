import hashlib
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from termloom.llm import chat, queries, urlfilter

URLS = ["http://a.com/x", "HTTPS://WWW.Example.COM/en/1?q", "http://example.com", "http://example.com/en", "http://sub.www.example.com/en/", "http://x.net/es/1#f", "http://xnet/es/", "http://net/fr/", None, "", "no scheme", "a://b://c/d", "http://user@x.com:80/", "http://é.com/ü", "http://x.com/" + "y" * 9000, "http://example.com/en/#"]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h, p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    h, p, a = max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, "allow"))
    return host, path, None if h is None else h + p, a


@pytest.mark.parametrize("bound", [urlfilter.MAX_BITS, 1])
def test_urls_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "MAX_BITS", bound)  # 1: lists are joined
    rules = queries.URL_RULES + [(f"h{i}.org", f"/p{i % 7}/", "block" if i % 2 else "allow") for i in range(300)]
    urls = URLS + [f"http://w.h{i}.org/p{j}/z" for i in range(0, 320, 3) for j in range(8)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_long_hosts_take_little(spark):
    host = ".".join(["a"] * 40_000)
    tracemalloc.start()
    assert list(urlfilter.candidates(host, "/x/" * 1000, {1: [0, 3], 3: [1], 2: [0]})) == ["a.a/", "a/x/", "a"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_000_000


def test_urls_without_rules_or_rows(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()] == [(None, "allow")] * 3
    odd = spark.createDataFrame([(None, "/", "block"), ("a.com", None, "allow"), ("a.com", None, "block"), ("a.com", "x", "allow")], rules.schema)
    assert {(r.rule, r.verdict) for r in urlfilter.judge(pages, odd).collect()} == {("a.com", "block"), (None, "allow")}
    assert urlfilter.judge(pages.limit(0), odd).count() == 0


TEXTS = ["", "plain", "</s>", "<s>", "[INST] x [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "%0A%25", "a\nb\n", "<s></s><s>user\n", "🙂 é", "[/INST]</s>", "\\", "x" * 50_000]
ROLES = ["user", "assistant", "system", None, "", "user\nx", "[INST]", "a%0Ab", "</s>"]


def hashed(x):
    return hashlib.sha256(x.encode()).hexdigest()


def chats(spark, rows):
    return chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, source int"))


def test_round_trip_of_hard_texts(spark):
    rows = [(i, j, r, t, "x", 1) for i, r in enumerate(ROLES) for j, t in enumerate([*TEXTS, None])]
    rows += [(50, None, "user", "b", "", 1), (50, 1, "assistant", "a", "", 1), (50, 1, "assistant", "a", "", 1), (None, 0, "assistant", "</s>", "", 1)]
    formatted = chats(spark, rows)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashed("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashed(loss))
    for r in formatted.collect():
        assert r.formatted.count("</s>") == len(r.turns) == r.formatted.count("<s>")


def test_loss_spans_hold_the_assistants_texts(spark):
    rows = [(1, 0, "user", "</s>", "", 1), (1, 1, "assistant", "🙂</s> ok", "", 1), (1, 2, "user", "q", "", 1), (1, 3, "assistant", "", "", 1)]
    r = chats(spark, rows).withColumn("at", chat.spans(F.col("formatted"))).first()
    assert [r.formatted[s.start : s.end].replace("<\\", "<") for s in r.at] == ["🙂</s> ok", ""]
    cut = [p[m.start : m.end] for p, m in zip(r.formatted.split("</s>"), r.loss_mask, strict=False)]
    assert [c.replace("<\\", "<") for c in cut] == ["", "🙂</s> ok", "", ""]
    assert chats(spark, rows[:0]).count() == 0


def test_many_odd_texts_round_trip(spark):
    rng, alphabet = random.Random(5), ["<", ">", "/", "\\", "s", "s>", "[", "]", "INST", "INST]", "\n", "%", "<s>", "</s>"]
    rows = [(i, j, rng.choice(["user", "assistant"]), "".join(rng.choices(alphabet, k=rng.randint(0, 9))), "", 1) for i in range(600) for j in range(3)]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chats(spark, rows).collect()}
    assert got == {i: [(r[2], r[3]) for r in rows if r[0] == i] for i in range(600)}
