"""Licences, URL filters, preference pairs, benchmark passages: small cases and edges."""

import random

from pyspark.sql import functions as F

from lecturelab.llm import decontaminate, licenses, preference, url_filter
from lecturelab.llm.queries import QUERIES, URL_RULES

DOC = "doc_id long, text string, lang string, source string"


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, mit), (2, "MIT\n" + mit), (3, "Copyright (c) 2024 Someone\nCopyright 2020 Another\n\n" + mit.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
        (4, "Copyright (c) 2024 Someone\n" + mit.replace(" ", "  \n").replace("sublicense", "sub-licence")), (5, "Some text.\nLicensed under the Apache Licence, version 2.0\nReleased under the MIT License."),
        (6, None), (7, ""), (8, "Licensed under nothing."), (None, "Released under the MIT License"), (5, "other")]
    df = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in rows], DOC + ", digest string")
    got = [tuple(r)[0:1] + tuple(r)[2:] for r in licenses.scan(df).collect()]
    want = [(1, "MIT", None, 0), (2, None, None, 0), (3, "MIT", None, 0), (4, "MIT", None, 0), (5, None, "Apache-2.0", 2), (6, None, None, 0), (7, None, None, 0), (8, None, None, 0), (None, "MIT", "MIT", 1), (5, None, "Apache-2.0", 2)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert licenses.scan(df.limit(0)).count() == 0


def plain_rule(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


URLS = [
    "http://example.com/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/", "https://EXAMPLE.com/EN/x", "http://example.com", "http://example.com?x=/en/", "http://example.com#/en/", "http://notexample.com/en/a",
    "x://b.net/es/1?q#f", "x://net/fr/", "net/es/", None, "", "://com/", "a://b://com/x", "http://É.Com/ä", "http://x.com:80/y", "http://shop.co.uk/a", "http://é.net/fr/\nline", "//com/x"]


def test_rules_match_plain_loops(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "id long, bad int")
    got = url_filter.judge(pages, labels, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, best = plain_rule(URLS[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.name if best else None)
        assert r["verdict"] == (best.verdict if best else "allow")
    assert url_filter.judge(pages.limit(0), labels, URL_RULES).count() == 0


def test_reputation_shrinks_to_parents(spark):
    rng, rows, n = random.Random(1), [], 0
    for host, count, rate in [("a.good.org", 200, 0.02), ("b.good.org", 2, 1.0), ("x.bad.biz", 200, 0.95), ("y.bad.biz", 1, 1.0), ("z.bad.biz", 0, 0), ("new.info", 0, 0)] + [(f"h{k}.d{k % 9}.net", 40, 0.1) for k in range(40)]:
        for _ in range(count):
            rows.append((n, host, int(rng.random() < rate)))
            n += 1
        rows.append((n, host, None))
        n += 1
    outcomes = spark.createDataFrame(rows, "id long, host string, bad int")
    rep = {r["host"]: r for r in url_filter.reputation(outcomes).collect()}
    assert rep["x.bad.biz"]["low"] > 0.5 > rep["b.good.org"]["low"] and rep["a.good.org"]["high"] < 0.2
    assert rep["z.bad.biz"]["low"] > rep["new.info"]["low"]
    assert all(0 <= r["low"] + 1e-9 and r["low"] <= r["high"] for r in rep.values() if r["n"] > 5)
    pages = outcomes.select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), "host", F.lit("/q")).alias("url"))
    verdict = url_filter.judge(pages, outcomes.where("bad is not null").select("id", "bad"), ()).where("verdict = 'block'").select("host").distinct().collect()
    assert {"x.bad.biz"} <= {r["host"] for r in verdict} <= {"x.bad.biz", "y.bad.biz", "z.bad.biz"}


TURN = "conv_id long, turn long, role string, text string, pair_id string"


def pairs(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "own") for c, t, r, x in rows], TURN)
    side = F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected")
    return {r["pair_id"]: r for r in preference.format_pairs(df, F.expr("conv_id div 2"), side).collect()}


def test_longest_common_prefix_is_the_prompt(spark):
    q, a, b, c = "What?", "Thïs.", "That\nis it.", "More"
    rows = [(0, 0, "user", q), (0, 1, "assistant", a), (0, 2, "user", c), (0, 3, "assistant", b)]
    rows += [(1, 3, "assistant", a), (1, 0, "user", q), (1, 1, "assistant", a), (1, 2, "user", c), (1, 0, "user", q)]
    rows += [(2, 0, "user", q), (2, 1, "assistant", a), (3, 0, "user", q), (3, 1, "assistant", a)]
    rows += [(4, 0, "user", q), (6, 0, None, None), (7, 0, None, None), (7, 1, "assistant", b), (None, 0, "user", q)]
    rows += [(8, 0, "user", q), (8, 1, "assistant", "a"), (9, 0, "user", c), (9, 1, "assistant", "long " * 50_000)]
    got = pairs(spark, rows)
    assert sorted(got) == [0, 1, 2, 3, 4]
    r = got[0]
    assert r["n_shared"] == 3 and r["usable"] and r["prompt"].count("<|end|>") == 3
    for side, answer in (("chosen", b), ("rejected", a)):
        lo, hi = map(int, r[f"{side}_mask"].split("-"))
        assert r[side][lo:hi] == answer and r[side] == f"<|assistant|>\n{answer}\n<|end|>\n"
    assert got[1]["n_shared"] == 2 and got[1]["chosen"] == got[1]["rejected"] == "" and not got[1]["usable"]
    assert got[2]["n_shared"] == 0 and got[2]["rejected"] == "" and not got[2]["usable"]
    assert got[3]["n_shared"] == 1 and got[3]["chosen"] == "" and not got[3]["usable"]
    assert got[4]["n_shared"] == 0 and got[4]["usable"]
    lo, hi = map(int, got[4]["rejected_mask"].split("-"))
    assert got[4]["rejected"][lo:hi] == "long " * 50_000
    assert pairs(spark, []) == {}


def test_pairs_share_all_but_the_last_answer(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (1, 4, "user", "thanks")]
    rows += [(2, 0, "user", "x"), (2, 1, "assistant", None), (2, 0, "user", "x"), (3, 0, "user", "alone"), (4, 0, "user", "y"), (4, 1, "assistant", "z"), (None, 0, "user", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_other", F.lit(1))
    got = {r["pair_id"]: r for r in preference.format_pairs(preference.with_other_answers(df), F.col("conv_id"), F.col("_side")).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["n_shared"] == 3 and got[1]["usable"] and "thanks" in got[1]["chosen"] and "thanks" in got[1]["rejected"]
    assert got[1]["rejected"].startswith("<|assistant|>\n\n") and not any(got[k]["usable"] for k in (2, 3, 4))
    assert preference.format_pairs(preference.with_other_answers(df.limit(0)), F.col("conv_id"), F.col("_side")).count() == 0
    sample = QUERIES["op8_preference_formatting"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["n_shared"] > 0 and r["usable"] for r in sample) > 0.5 * len(sample)


def passages(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in docs], DOC + ", item_id string")
    b = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    return d, b, sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect())


def test_passages_with_replaced_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (40, 14, 25, 300)]
    fill = lambda n: [word() for _ in range(n)]

    def broken(words, step):
        return [w if k % step else "zz" for k, w in enumerate(words)]

    docs = [
        (1, " ".join(fill(50) + items[0] + fill(50))), (2, ", ".join(items[1]).upper()), (3, " ".join(fill(9) + broken(items[0], 6) + fill(3))),
        (4, " ".join(fill(500))), (5, " ".join(items[0][:6] + fill(30) + items[2][:6])), (6, " ".join(broken(items[0], 2))),
        (7, " ".join(fill(20) + items[3][100:160])), (8, None), (9, ""), (None, " ".join(items[0])), (1, " ".join(fill(4) + items[2])), (10, " ".join(fill(30_000) + items[1]))]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(50, " ".join(items[0])), (None, None), (51, ""), (52, "too short")]
    d, b, got = passages(spark, docs, bench)
    assert got == [(1, 0), (1, 2), (2, 1), (3, 0), (7, 3), (10, 1)]
    kept = decontaminate.remove(d, b)
    assert sorted(kept.columns) == sorted(d.columns)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [4, 5, 6, 8, 9]  # a row without an id that holds a passage goes as well
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0
