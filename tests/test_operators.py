import pytest
from pyspark.sql import functions as F

from skein.functions import ids, text, times
from skein.operators import chains, closure, decisions, log, messages, pareto, search, training


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


ITEM = "id string, text string, created_at string, parent_id string, reply_user_id string, account_id string, source string, ord long"


def item(i, parent=None, source="twitter:tweet", ord=0, account=None, to=None, said="t", at=None):
    return (i, said, at, parent, to, account, source, ord)


def test_event_id_is_the_known_uuid(spark):
    row = spark.range(1).select(ids.event_id(F.lit("twitter"), F.lit("item"), F.lit("1000000000000000001")).alias("x")).first()
    assert row.x == "0e5f1b5b-ce46-8d3b-bd33-5c88b6b5bccd"


def test_text_functions(spark):
    t = "Hi @a.b see https://t.co/xyz #tag\r\n\r\n\r\n\r\nend  "
    row = spark.createDataFrame([(t, "RT @me: x", "RTé", "a𝔸")], "t string, r string, e string, astral string").select(
        text.clean(F.col("t")).alias("clean"), text.is_retweet(F.col("r")).alias("r"), text.is_retweet(F.col("e")).alias("e"), text.utf16_length(F.col("astral")).alias("n"), text.slug(F.lit("A b! c/d e f g")).alias("slug"), text.file_stem(F.lit("!!")).alias("stem"), text.character_id(F.lit("--Ä x__")).alias("who"), text.html_to_markdown(F.lit('<p>a <b>b</b></p><p><a href="u">l</a> &amp;</p>')).alias("md")
    ).first()
    assert row.clean == "Hi see\n\nend"
    assert (row.r, row.e, row.n, row.slug, row.stem, row.md) == (True, True, 3, "A_b_cd_e_f", "untitled", "a **b**\n\n[l](u) &")
    assert row.who == "--_x"


def test_times(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "Jan 05, 2019  3:04 PM", "Wed Oct 10 20:19:24 +0000 2018", "nonsense", None]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(times.normalised(F.col("t"), F.lit("-")).alias("n")).select("n.*")
    assert [tuple(r) for r in df.collect()] == [(rows[0], "verbatim"), (rows[1], "verbatim"), ("2019-01-05T15:04:00.000Z", "parsed"), ("2018-10-10T20:19:24.000Z", "parsed"), ("-", "fallback"), ("-", "fallback")]
    row = spark.range(1).select(times.anchor_date(F.lit('<a href="x">February 31, 2019</a>')).alias("bad"), times.anchor_date(F.lit('<a href="x">June 1, 2006</a>')).alias("ok")).first()
    assert row.bad is None and str(row.ok) == "2006-06-01 00:00:00"


def test_chains_threads_and_conversations(spark):
    rows = [item("100", None, ord=0, account="me"), item("101", "100", ord=1, account="me", to="me"), item("102", "100", ord=2, account="me", to="you")]
    found = chains.chains(spark.createDataFrame(rows, ITEM))
    assert values(found.select("chain_id", "kind", "pos", "id")) == [("100", "thread", 0, "100"), ("101", "thread", 0, "100"), ("101", "thread", 1, "101"), ("102", "conversation", 0, "100"), ("102", "conversation", 1, "102")]
    # leaf first: the root isn't a start of its own
    rows = [item("b", "a", ord=0), item("a", None, ord=1)]
    assert values(chains.chains(spark.createDataFrame(rows, ITEM)).select("chain_id").distinct()) == [("b",)]


def test_last_row_of_an_id_takes_the_first_place(spark):
    rows = [item("x", ord=0, said="old"), item("7", ord=1), item("x", ord=2, said="new"), item("", ord=3)]
    out = chains.latest_by_id(spark.createDataFrame(rows, ITEM)).orderBy("ord").collect()
    assert [(r.id, r.text) for r in out] == [("7", "t"), ("x", "new")]


def test_cycles_raise(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    for f in (closure.ancestors, closure.roots):
        with pytest.raises(closure.CycleError):
            f(nodes)


def test_long_chain(spark):
    nodes = spark.range(300).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    assert values(closure.roots(nodes).agg(F.min("root"), F.max("root"), F.max("depth"))) == [("0", "0", 299)]


def test_filters(spark):
    rows = [item("1", at="2024-01-01T00:00:00Z"), item("2", at="bad"), item("3", source="bluesky:fetched", at="bad"), item("4", said="RT x", at="2024-01-01T12:00:00Z")]
    df = spark.createDataFrame(rows, ITEM)
    keep = chains.filtered(df, since="2024-01-01", until="2024-01-02", exclude_retweets=True)
    assert values(keep.select("id")) == [("1",), ("3",)]


def test_messages(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("assistant", "lead"), ("user", "a"), ("user", ""), ("user", "b"), ("assistant", "c"), ("assistant", "d"), ("user", "tail")])]
    turns = spark.createDataFrame(rows, "g long, i long, role string, text string")
    out = messages.to_last_assistant(messages.merged(turns, ["g"], ["i"]), ["g"]).orderBy("island").collect()
    assert [(r.role, r.content) for r in out] == [("assistant", "lead"), ("user", "a\n\nb"), ("assistant", "c\n\nd")]
    assert values(messages.segments(turns, ["g"], ["i"])) == [(1, 0, "a\n\nb", "c\n\nd")]


def test_decisions_fold(spark):
    shape = "id string, status string, tags array<string>, notes string, ts timestamp, by string, ord long"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", "export", ["x"], "n", at(5), None, 0), ("a", "skip", ["y"], None, at(3), "me", 1), ("a", None, ["x", "z"], "m", at(5), None, 2)]
    df = decisions.fold(spark.createDataFrame(rows, shape))
    assert values(df, "id", "status", "notes", "by", "tags") == [("a", "export", "m", None, ["x", "y", "z"])]


def line(i, parents="[]", more="", at="2024-01-01T00:00:00Z"):
    return f'{{"v":1,"id":"{i}","kind":"a/b","at":"{at}","author":{{"actor":"me"}},"parents":{parents},"payload":{{"text":"x"}}{more}}}'


def test_log_classes(spark):
    import hashlib

    good = line("d1")
    digest = hashlib.sha256(good.encode()).hexdigest()
    signed, broken = (f'{good[:-1]},"digest":"sha256:{d}"}}' for d in (digest, "0" * 64))
    rows = [line("a"), line("a"), line("c"), line("c", more=',"critical":true'), "garbage", '{"v":1}', signed, broken, line("t", '["a"]', ',"critical":true'), line("n", at="never")]
    df = log.classified(spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "file string, line long, text string")).cache()
    assert [r["class"] for r in df.orderBy("line").collect()] == ["accepted", "accepted", "conflict-variant", "conflict-variant", "garbage", "nonconforming", "accepted", "damaged", "accepted", "nonconforming"]
    assert values(log.eligible(df), "id", "suppressed") == [("a", True), ("d1", False), ("n", False), ("t", False)]
    assert values(log.dangling(spark.createDataFrame([("x", ["y"])], "id string, parents array<string>"))) == [("x", "y")]


def test_pinned_mean_and_front(spark):
    s = spark.createDataFrame([("t", "b", 1.0), ("t", "a", 2.0)], "target string, annotation string, value double")
    sel = spark.createDataFrame([("s", ["t"], ["t", "u"])], "id string, chosen array<string>, shown array<string>")
    assert values(training.leaderboard(s, sel), "target", "mean", "selected_count", "rank") == [("t", 1.5, 1, 1), ("u", None, 0, 2)]
    rows = [("A", "k", 1.0, True, 0), ("A", "k", 3.0, True, 1), ("B", "k", 3.0, True, 2), ("B", "j", 9.0, False, 3), ("A", "j", 0.0, True, 4)]
    assert values(pareto.front(spark.createDataFrame(rows, "candidate string, key string, score double, accepted boolean, ord long"))) == [("A", 2)]


def test_search(spark):
    rows = spark.createDataFrame([(1, "abcdef"), (2, "xxbcdx"), (3, "BCD"), (4, "bc d")], "id long, text string")
    want = [(1, "abcdef"), (2, "xxbcdx")]
    assert values(search.literal(rows, "bcd", ["id"])) == want
    assert values(search.by_postings(rows, search.postings(rows, ["id"]), "bcd", ["id"], ["id"]).select("id", "text")) == want
    with pytest.raises(ValueError):
        search.literal(rows, "bc", ["id"])


def test_reconcile(spark):
    log.reconcile(spark.createDataFrame([(3, 1, 2)], "total long, a long, b long"), "total", ["a", "b"])
    with pytest.raises(ValueError):
        log.reconcile(spark.createDataFrame([(3, 1, 1)], "total long, a long, b long"), "total", ["a", "b"])


def test_page_gaps(spark):
    from skein.sources.exports import page_gaps

    pages = spark.createDataFrame([(n,) for n in (3, 4, 4, 9, 70_000, 70_001, 200_000, None)], "number long")
    assert sorted(map(tuple, page_gaps(pages).collect())) == [(5, 8), (10, 69_999), (70_002, 199_999)]
    assert page_gaps(pages.where("number = 3")).count() == 0 and page_gaps(pages.where("false")).count() == 0


def test_heights_and_nearest(spark):
    rows = [(1, None, 1), (2, 1, 0), (3, 2, 0), (4, 3, 1), (5, 4, 0), (6, 2, 0), (7, 99, 0), (8, 7, None)]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, kept int")
    assert dict(map(tuple, closure.heights(nodes).collect())) == {1: 4, 2: 3, 3: 2, 4: 1, 5: 0, 6: 0, 7: 1, 8: 0}
    found = dict(map(tuple, closure.nearest(nodes, F.col("kept") == 1).collect()))
    assert found == {1: None, 2: 1, 3: 1, 4: 1, 5: 4, 6: 1, 7: None, 8: None}
    long = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id long, parent_id long")
    assert dict(map(tuple, closure.heights(long).collect())) == {i: 299 - i for i in range(300)}
    assert closure.heights(nodes.where("false")).count() == 0
    with pytest.raises(closure.CycleError):
        closure.heights(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent_id long"))


def test_climbed_and_paths(spark):
    rows = [(1, None, False, 9), (2, 1, True, 8), (3, 2, False, None), (4, 3, False, 3), (5, 2, False, 7), (6, 99, False, 1)]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, bad boolean, v long")
    found, jumps = closure.climbed(nodes, anywhere={"bad": F.col("bad")}, least={"low": F.col("v")})
    assert values(found, "node", "root", "depth", "bad", "low") == [(1, 1, 0, False, 3), (2, 1, 1, True, 3), (3, 1, 2, True, 3), (4, 1, 3, True, 3), (5, 1, 2, True, 7), (6, 6, 0, False, 1)]
    ways = closure.paths(spark.createDataFrame([(4, "x"), (6, "y")], "node long, tag string"), jumps)
    assert values(ways, "tag", "at", "distance") == [("x", 1, 3), ("x", 2, 2), ("x", 3, 1), ("x", 4, 0), ("y", 6, 0)]
    assert closure.climbed(nodes.where("false"))[0].count() == 0


def test_chains_branch_and_fetched(spark):
    rows = [item("r", source="external", ord=0), item("a", "r", ord=1), item("b", "r", source="bluesky:fetched", ord=2), item("c", "b", ord=3), item("d", "gone", ord=5), item("e", "d", ord=4), item("f", None, source=None, ord=6)]
    items = spark.createDataFrame(rows, ITEM)
    heads, _ = chains.chain_heads(items)
    # b was fetched, d comes after its reply e, f names no source
    assert values(heads, "chain_id", "root_id", "n", "kind") == [("a", "r", 2, "conversation"), ("c", "r", 3, "conversation"), ("e", "d", 2, "thread"), ("r", "r", 1, "conversation")]
    built = chains.chains(items, longest=True)
    assert values(built, "chain_id", "pos", "id") == [("c", 0, "r"), ("c", 1, "b"), ("c", 2, "c"), ("e", 0, "d"), ("e", 1, "e")]
    assert values(chains.longest_per_root(chains.chains(items)), "chain_id", "pos", "id") == values(built, "chain_id", "pos", "id")
    assert values(chains.only_threads(heads), "chain_id") == [("e",)]


def test_contexts(spark):
    rows = [("a", None, "A", False, False, "x"), ("b", "a", None, False, False, "x"), ("c", "b", "C", True, False, "x"), ("d", "c", "D", False, True, "x"), ("e", "d", "E", False, False, "x"), ("g", "gone", "G", False, False, "x"), ("h", "g", "H", False, False, "x"), ("i", "b", "I", False, False, "x")]
    events = spark.createDataFrame(rows, "id string, parent string, text string, suppressed boolean, marked boolean, actor string")
    shown = ("id", "segments", "partial", "suppressed_context", "no_train_context")
    everything = [("a", [], False, False, False), ("b", ["A"], False, False, False), ("c", ["A"], False, False, False), ("d", ["A"], False, True, False), ("e", ["A", "D"], False, True, True), ("g", [], True, False, False), ("h", ["G"], True, False, False), ("i", ["A"], False, False, False)]
    assert values(training.contexts(events), *shown) == everything
    some = training.contexts(events, spark.createDataFrame([("i",), ("h",), ("i",), ("none",)], "id string"))
    assert values(some, *shown) == [("h", [], True, False, False), ("i", ["A"], False, False, False)]
    board = spark.createDataFrame([(t, 1.0, 1, 0) for t in "adehi"], "target string, mean double, score_count long, selected_count long")
    rows = training.sft(events, board, training.contexts(events, training.candidates(events, board)))
    assert values(rows, "target", "skip", "segments")[0] == ("a", None, []) and values(rows.where("skip is null"), "target") == [("a",), ("i",)]
    # gates of their own come first, so events outside the candidates need no context
    assert values(rows.where("skip is not null"), "target", "skip") == [("d", "no-train"), ("e", "suppressed-context"), ("h", "partial")]
    picks = spark.createDataFrame([("s", ["i"], ["i", "c", "b"])], "id string, chosen array<string>, shown array<string>")
    assert values(training.chosen(events, picks)) == [("i",)]
    pairs = training.preferences(events, picks, training.context_faults(events)[0])
    assert values(pairs, "chosen", "rejected", "skip") == [("i", "b", "no-text"), ("i", "c", "suppressed")]


def test_large_lines(spark, tmp_path):
    from skein.sources.exports import read_large_lines

    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\r\n\n" for i in range(500)))
    rows = read_large_lines(spark, str(tmp_path)).orderBy("file", "place").collect()
    assert [r.text for r in rows] == [f"line {i}" for i in range(500)]


def test_isolated_links_line_by_line(spark):
    """Against the rule told line by line, over many arrangements."""
    import random
    import re

    from skein.functions.text import isolate_links

    found = re.compile(r"(https?://(?:www\.)?(?:twitter|x)\.com/[A-Za-z0-9_]+/status/[0-9]+(?:\?[^)\s]*)?)")

    def plain(text):
        lines, out = found.sub(r"\n\1\n", text).split("\n"), []
        for i, line in enumerate(lines):
            if not found.fullmatch(line.strip()):
                out.append(line)
                continue
            if out and out[-1].strip():
                out.append("")
            out.append(line.strip())
            if i + 1 < len(lines) and lines[i + 1].strip():
                out.append("")
        return re.sub("\n{3,}", "\n\n", "\n".join(out))

    dealt = random.Random(3)
    parts = ["https://x.com/a/status/1", "http://www.twitter.com/b_c/status/22?s=1&t=(x", "\n", "\n\n", " ", "\t", "word", ")", "(", ".", "12", "https://x.com/a", " ", "?q"]
    texts = ["".join(dealt.choice(parts) for _ in range(dealt.randrange(9))) for _ in range(3000)] + ["(see https://x.com/a/status/1). more"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", isolate_links(F.col("t")).alias("t")).collect()
    bad = [(texts[r.i], r.t, plain(texts[r.i])) for r in rows if r.t != plain(texts[r.i])]
    assert not bad, bad[:3]


def test_clean_with_rare_white_space(spark):
    from skein.functions.text import clean, trim

    rows = [" a \t b \n\n\n\n c　", " x  y \n  z ", "é\t\n \n\t\nü", "\x0b a \x0b\n b"]
    out = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(clean(F.col("t"))).collect()]
    assert out == ["a b\n\nc", "x  y\nz", "é\n\nü", "a\nb"]
    assert [r[0] for r in spark.createDataFrame([("\n é \t",), ("﻿ é",)], "t string").select(trim(F.col("t"))).collect()] == ["é", "é"]


def test_a_line_of_33_megabytes_is_an_event(spark):
    from skein.operators import log

    whole = lambda end: '{"v":1,"id":"g","kind":"n/x","at":"2026-01-01T00:00:00Z","author":{"actor":"me"},"parents":[],"payload":{"text":"' + "y" * 33_000_000 + end
    rows = log.classified(spark.createDataFrame([("f", 1, whole('"}}')), ("f", 2, whole('"}')), ("f", 3, whole(""))], "file string, line long, text string"))
    found = rows.select("line", "class", "id", "actor", F.length("payload").alias("size")).orderBy("line").collect()
    assert tuple(found[0]) == (1, "accepted", "g", "me", 33_000_011)
    assert [r["class"] for r in found[1:]] == ["garbage", "garbage"]
