"""Excerpts of benchmark items, from any place and with replaced words."""

import random

import duckdb

from lecturelab.llm import decontaminate


def test_excerpts_from_start_middle_and_end(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    item = [word() for _ in range(60)]
    fill = lambda: [word() for _ in range(30)]
    docs, want, not_wanted = [], set(), set()
    for at in (0, 1, 9, 20, 31, 46, 47):
        for n in (9, 13, 14, 16):
            if at + n <= len(item):
                docs.append((len(docs), " ".join(fill() + item[at: at + n] + fill())))
                (want if n >= decontaminate.RUN else not_wanted).add(docs[-1][0])
    for step in range(4):  # three of four words agree
        docs.append((len(docs), " ".join(fill() + [f"other{k}" if k % 4 == step else w for k, w in enumerate(item)] + fill())))
        want.add(docs[-1][0])
    docs.append((len(docs), " ".join(fill() + [f"other{k}" if k % 3 == 0 else w for k, w in enumerate(item)])))  # two of three do not
    not_wanted.add(docs[-1][0])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:7])), (3, " ".join(fill()))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(k, 1) for k in want} and not want & not_wanted
    assert sorted(map(tuple, decontaminate.leaks(d, b).collect())) == by_sql(docs, [(r["item_id"], r["text"]) for r in b.collect()])


def by_sql(docs, items):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    return sorted(con.execute(decontaminate.oracle()).fetchall())


def test_short_items_and_the_sql(spark):
    words = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(f"s{k}" for k in range(7))), (3, " ".join(f"e{k}" for k in range(8)))]
    docs = [(1, " ".join(words[20:33])), (2, "x " + items[1][1] + " y"), (3, "x " + items[2][1] + " y"), (4, " ".join(words[20:32])), (5, None), (None, items[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.leaks(d, b).collect()))
    assert got == by_sql(docs, items) == [(1, 1, 13), (3, 3, 8)]


def test_rows_without_an_id_go_too(spark):
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(None, item, 1), (None, "else", 2), (7, item, 3), (7, "another text", 4), (8, None, 5), (9, "x " + item, 6), (9, "x " + item, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _k int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.remove(d, b)
    assert sorted(r["_k"] for r in kept.collect()) == [2, 4, 5] and kept.columns == d.columns
