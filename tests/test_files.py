import json

import pytest
from pyspark.sql import functions as F

from skein.operators import chains
from skein.sinks import files
from skein.sinks.store import Store
from skein.sources import archive, exports
from skein.streaming import union


@pytest.fixture
def root(tmp_path):
    data = tmp_path / "archive" / "data"
    data.mkdir(parents=True)
    (data / "manifest.js").write_text('window.__THAR_CONFIG = {"dataTypes": {"tweets": {"files": [{"fileName": "data/tweets.js"}]}, "like": {"files": [{"fileName": "data/like.js"}]}, "other": {"files": [{"fileName": "data/x.js"}]}}};')
    (data / "account.js").write_text('window.YTD.account.part0 = [{account: {accountId: "9", username: "me",},},];')
    (data / "tweets.js").write_text("window.YTD.tweets.part0 = [{tweet: {id: '1', full_text: 'a, }b', created_at: 'Wed Oct 10 20:19:24 +0000 2018',}}, {tweet: {id: '2', full_text: 'reply', in_reply_to_status_id: '1', in_reply_to_user_id: '9'}}, {tweet: {full_text: 'no id'}}];")
    (data / "like.js").write_text('window.YTD.like.part0 = [{"like": {"tweetId": "5", "fullText": "liked"}}]')
    media = data / "tweets_media"
    media.mkdir()
    (media / "1-pic.jpg").write_bytes(b"x")
    (media / "1-empty.jpg").write_bytes(b"")
    return str(tmp_path / "archive")


def test_archive(spark, root, tmp_path):
    assert archive.detect(spark, root) == "twitter" and archive.detect(spark, str(tmp_path)) is None
    items = archive.read_archive(spark, root)
    found = [(r.id, r.text, r.parent_id, r.account_id, r.source) for r in items.orderBy("ord").collect()]
    assert found == [("1", "a, }b", None, "9", "twitter:tweet"), ("2", "reply", "1", "9", "twitter:tweet"), ("5", "liked", None, "9", "twitter:like")]
    media = archive.with_media(items, archive.read_media(spark, root)).where("media is not null").select("id", F.col("media")[0]["id"], F.col("media")[0]["content_type"]).collect()
    assert [tuple(r) for r in media] == [("1", "1_pic", "photo")]
    chained = chains.chains(items).withColumn("at", F.to_timestamp(F.lit("2020-01-02"))).withColumn("handle", F.lit("me"))
    docs = files.markdown_posts(chained)
    assert [r.path for r in docs.collect()] == ["threads/20200102/a_b.md"]
    files.write_documents(docs, str(tmp_path / "out"))
    assert "reply" in (tmp_path / "out/threads/20200102/a_b.md").read_text()
    row = files.archive_stats(items, chained).first()
    assert (row["items"], row.tweets, row.likes, row.threads, row.conversations) == (3, 2, 1, 2, 1)


def test_thread_export(spark, tmp_path):
    p = tmp_path / "thread.json"
    p.write_text(json.dumps({"id": "t", "title": "x", "url": "u", "posts": [{"post_id": "1", "author": "a", "character_handle": "h", "timestamp": "Jan 05, 2019  3:04 PM", "content": "<p>Hi <i>you</i></p>"}, {"content": "<p>b</p>"}]}))
    assert [(r.id, r.text) for r in exports.read_threads(spark, str(p)).orderBy("ord").collect()] == [("t:1", "Hi *you*"), ("t:idx-1", "b")]


def test_claude_export(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"uuid": "c", "name": "n", "chat_messages": [{"uuid": "m1", "sender": "human", "text": "q"}, 7, {"uuid": "m2", "sender": "assistant", "text": "", "content": [{"type": "tool", "name": "x"}]}]}, {"uuid": "none"}]))
    rows = exports.read_claude_export(spark, str(p)).collect()
    found = sorted(((r.id, r.parent_id, r.role, r.text, r.skip) for r in rows), key=repr)
    assert ("m1", None, "user", "q", None) in found and ("m2", "m1", "assistant", "[tool:x]", None) in found
    assert sorted(r.skip for r in rows if r.skip) == ["message isn't an object", "no chat_messages"]


def test_chatgpt_export(spark, tmp_path):
    p = tmp_path / "g.json"
    node = lambda parent, role=None, parts=None: {"parent": parent, "children": [], "message": role and {"author": {"role": role}, "content": {"content_type": "text", "parts": parts}, "metadata": {}}}
    p.write_text(json.dumps([{"id": "c", "title": "t", "mapping": {"r": node(None), "a": node("r", "user", ["q"]), "b": node("a", "assistant", ["x", {"content_type": "image"}])}}, 3]))
    rows = exports.read_chatgpt_export(spark, str(p)).collect()
    assert sorted(((r.id, r.parent_id, r.text) for r in rows if r.has_message), key=repr) == [("a", "r", "q"), ("b", "a", "x\n\n[image]")]
    nodes = exports.read_chatgpt_export(spark, str(p)).where("id is not null")
    near = chains.nearest_kept_ancestor(nodes, F.col("has_message"))
    assert sorted(map(tuple, near.collect()), key=repr) == [("a", None), ("b", "a"), ("r", None)]


def test_embeds_and_pages(spark, tmp_path):
    d = tmp_path / "cache"
    d.mkdir()
    (d / "1094686426143526912-light.json").write_text(json.dumps({"url": "https://twitter.com/me/status/1094686426143526912", "author_url": "https://twitter.com/me", "html": "<p>hello</p>"}))
    (d / "7-light.json").write_text(json.dumps({"url": "https://twitter.com/me/status/8", "html": ""}))
    rows = {r.file: r for r in exports.read_embed_cache(spark, str(d)).collect()}
    good = rows["1094686426143526912-light.json"]
    assert (good.rung, good.actor, good.text, good.skip) == ("snowflake", "me", "hello", None)
    assert rows["7-light.json"].skip == "ids disagree"
    p = tmp_path / "pages"
    p.mkdir()
    for name, body in {"page-1.txt": "a", "page-01.txt": "b", "page-3.txt": "", "page-4.desc.txt": "d", "x.md": "m", "y.bin": ""}.items():
        (p / name).write_text(body)
    report = exports.page_report(exports.read_page_files(spark, str(p)))
    assert sorted(map(tuple, report.collect())) == [("duplicate", 1), ("empty", 3), ("missing desc", 1), ("missing desc", 3), ("orphan desc", 4)]


def test_event_lines_round_trip(spark, tmp_path):
    from skein.operators import log

    e = spark.createDataFrame([("i", "a/b", "2024-01-01T00:00:00Z", 'm"e', ["p"], '{"text":"x"}', False)], "id string, kind string, at string, actor string, parents array<string>, payload string, critical boolean")
    files.write_lines(files.event_lines(e, digest=True), str(tmp_path / "log"))
    rows = log.classified(exports.read_event_files(spark, str(tmp_path / "log") + "/part-*")).collect()
    assert [(r["class"], r.id, r.actor, r.payload, r.parents) for r in rows] == [("accepted", "i", 'm"e', '{"text":"x"}', ["p"])]


def test_chat_lines(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "g long, island long, role string, content string")
    assert json.loads(files.chat_lines(m, ["g"], "sys").first().value)["messages"] == [{"role": "system", "content": "sys"}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    assert json.loads(files.sharegpt_lines(m, ["g"]).first().value) == {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    ref = store.put_table(a)
    assert ref == store.put_table(a.orderBy(F.desc("a"))) and store.get_table(ref).count() == 2
    one = store.checkpoint("2024-01-01T00:00:00Z", {"items": ref}, [])
    two = store.checkpoint("2024-01-02T00:00:00Z", {"items": ref}, [])
    assert store.latest() == two and store.checkpoints()[1]["parentId"] == one
    store.publish(a, {"v": 1})
    assert store.current().count() == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", "x", "k", "2024-01-01 00:00:00"), ("a", "x", "k", "2024-01-01 00:00:00"), ("a", "y", "k", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "id string, text string, kind string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(src))
    stream = spark.readStream.schema("id string, text string, kind string, at timestamp").parquet(str(src))
    for name, df, mode in (("once", union.deduplicated(stream), "append"), ("clash", union.conflicts(stream), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 2
    assert [(r.id, r.lines) for r in spark.table("clash").collect()] == [("a", 3)]
