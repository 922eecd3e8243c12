import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skein.operators import chains, closure, log, looms
from skein.sources import exports


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


EVENT = "loom string, id string, kind string, parents array<string>, ord long, role string, author string, text string"


def event(i, parents, ord, kind="claude/user", loom="l"):
    return (loom, i, kind, parents, ord, "user", "me", None if i == "b" else f"text {i}")


def plain_order(rows):
    """Ids in the reader's order, by visiting."""
    by_id, out = {r[1]: r for r in rows}, []

    def visit(r):
        if r[1] not in out:
            if r[3] and r[3][0] in by_id:
                visit(by_id[r[3][0]])
            out.append(r[1])

    for r in sorted(rows, key=lambda r: r[4]):
        visit(r)
    return out


def test_turns_stand_in_the_reader_s_order(spark):
    rows = [event("a", ["d"], 0), event("b", ["a", "c"], 1), event("c", [], 2), event("d", ["c"], 3), event("e", ["x"], 4), event("f", ["n"], 5), event("g", ["a"], 6)]
    notes = [event("n", ["a"], 7, kind="session/note"), event("m", [], 8, kind=None)]
    events = spark.createDataFrame([*rows, *notes, event("z", ["a"], 9, loom="other")], EVENT)
    placed = looms.session_turns(events)
    own = placed.where("loom = 'l'").orderBy("place").collect()
    assert [r.id for r in own] == plain_order(rows) == ["c", "d", "a", "b", "e", "f", "g"]
    # neither an absent parent, nor one that is no turn, nor one of another loom
    assert {r.id: r.parent_id for r in own} == {"a": "d", "b": "a", "c": None, "d": "c", "e": None, "f": None, "g": "a"}
    assert values(placed.where("loom = 'other'"), "id", "parent_id", "place") == [("z", None, 0)]
    assert values(looms.other_kinds(events), "kind", "n") == [("session/note", 1), (None, 1)]
    with pytest.raises(closure.CycleError):
        looms.session_turns(spark.createDataFrame([event("a", ["b"], 0), event("b", ["a"], 1)], EVENT))
    assert values(chains.source_order(spark.createDataFrame([], "id string, parent_id string, ord long"))) == []


def test_snapshots_are_checked(spark):
    rows = [event("a", [], 0), event("b", ["a"], 1), event("c", [], 0, loom="k/1")]
    written = looms.snapshots(looms.session_turns(spark.createDataFrame(rows, EVENT)), {"source": "session"})
    first = json.loads(written.where("loom = 'l'").first()["value"])
    turns = [{"id": "a", "parentId": None, "payload": {"text": "text a"}, "meta": {"role": "user", "author": "me"}}, {"id": "b", "parentId": "a", "payload": {"text": None}, "meta": {"role": "user", "author": "me"}}]
    assert first == {"loom": {"id": "l", "meta": {"profile": "conversation", "source": "session"}}, "turns": turns}
    assert values(looms.verified(written), "loom", "turns", "problems") == [("k/1", 1, ""), ("l", 2, "")]
    assert values(looms.file_names(written, "session"), "name") == [("session-0001-k_1.json",), ("session-0002-l.json",)]
    swapped, twice = (json.dumps({**first, "turns": t}) for t in (turns[::-1], [turns[0], turns[0]]))
    other = json.dumps({"loom": {"id": "l", "meta": {"profile": "x"}}, "turns": []})
    bad = spark.createDataFrame([("1", 2, swapped), ("2", 2, twice), ("3", 0, other), ("4", 1, "{"), ("5", 3, json.dumps(first))], "loom string, turns long, value string")
    assert dict(values(looms.verify(bad), "loom", "problems")) == {"1": "parents that don't come before", "2": "ids twice", "3": "profile", "4": "no snapshot, profile, number of turns", "5": "number of turns"}
    with pytest.raises(ValueError):
        looms.verified(bad)
    row = spark.range(1).select(looms.role_of(F.lit("Me"), F.lit("me")).alias("a"), looms.role_of(F.lit(None), F.lit("me")).alias("b")).first()
    assert tuple(row) == ("user", "assistant")


def test_verified_log(spark):
    line = '{"v":1,"id":"%s","kind":"a/b","at":"2024-01-01T00:00:00Z","author":{"actor":"me"},"parents":[],"payload":{}}'
    rows = log.classified(spark.createDataFrame([("f", 0, line % "x"), ("f", 1, line % "y")], "file string, line long, text string"))
    assert values(log.verified(rows)) == [("a/b", 2, 2, 0)]
    with pytest.raises(ValueError, match="f:1 is garbage"):
        log.verified(log.classified(spark.createDataFrame([("f", 0, line % "x"), ("f", 1, "?")], "file string, line long, text string")))


def test_tree_scan_and_digests(spark, tmp_path):
    (tmp_path / "a b" / "c").mkdir(parents=True)
    (tmp_path / "z.jsonl").write_bytes(b"\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "a b" / "c" / "d.jsonl").write_bytes(b"{}\n")
    (tmp_path / "a b" / "note.txt").write_bytes(b"x")
    assert values(exports.scan_tree(spark, str(tmp_path)), "path", "bytes", "taken") == [("a b/c/d.jsonl", 3, True), ("a b/note.txt", 1, False), ("z.jsonl", 1, True)]
    assert values(exports.file_digests(spark, f"file://{tmp_path}/")) == [(p, len(b), hashlib.sha256(b).hexdigest()) for p, b in (("a b/c/d.jsonl", b"{}\n"), ("z.jsonl", b"\n"))]


def test_thread_urls(spark):
    urls = {"https://example.com/posts/1": True, "https://www.EXAMPLE.com/boards/2?x=1": True, "http://notexample.com/posts/1": False, "https://example.com.evil.org/posts/1": False, "https://example.com/users/1": False, "https://example.com/users?next=/posts/1": False, "example.com/board_sections/3": True, "posts/1": False, None: False}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", exports.is_thread_url(F.col("u"), "example.com").alias("ok"))
    assert {r.u: r.ok for r in df.collect()} == urls


def test_embed_media(spark):
    blob = {"ref": {"$link": "cid1"}, "mimeType": "image/png", "size": 7}
    images = {"$type": "app.bsky.embed.images", "images": [{"image": blob, "alt": "A"}, {"alt": "lost"}]}
    video = {"$type": "app.bsky.embed.video", "video": {"cid": "v", "mimeType": "video/mp4", "size": 9}, "alt": "V"}
    records = [{"embed": images}, {"embed": {"$type": "app.bsky.embed.recordWithMedia", "media": video}}, {"embed": {"$type": "app.bsky.embed.video"}}, {"text": "none"}]
    df = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(records)], "u string, r string")
    found = {r.u: [m and tuple(m) for m in r.m] for r in df.select("u", exports.embed_media(F.col("u"), F.parse_json("r")).alias("m")).collect()}
    assert found == {"0": [("0#image-0", "photo", "cid1", "image/png", 7, "A"), None], "1": [("1#video", "video", "v", "video/mp4", 9, "V")], "2": [], "3": []}


def test_diagnostics_and_attachments(spark):
    line = '{"v":1,"id":"%s","kind":"a/b","at":"2024-01-01T00:00:00Z","author":{"actor":"me"},"parents":%s,"payload":{"n":%d}%s}'
    texts = [line % ("a", '["gone","c","c"]', 0, ""), line % ("b", '["gone"]', 0, ""), line % ("c", "[]", 0, ""), line % ("c", "[]", 1, ""), line % ("d", '["a"]', 0, ',"critical":true'), "?"]
    rows = log.classified(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line long, text string"))
    assert values(log.diagnostics(rows)) == [("class", "accepted", 3), ("class", "conflict-variant", 2), ("class", "garbage", 1), ("conflict", "c", 2), ("missing", "gone", 2), ("unavailable", "c", 1), ("withheld", "a", 1)]
    shape = "id string, annotation boolean, label string, parents array<string>, critical boolean, suppressed boolean, ignored boolean"
    marks = [("2", True, "note", ["t"], False, False, False), ("1", True, None, ["t", "u"], False, False, False), ("3", True, "score", ["t"], False, False, False), ("4", True, "score", ["t"], False, False, True), ("5", True, "note", ["t"], False, True, False), ("6", False, None, ["t"], True, False, False)]
    assert values(log.attachments(spark.createDataFrame(marks, shape))) == [("t", "generic", ["1", "2"]), ("t", "ignored", ["4"]), ("t", "suppressors", ["6"]), ("u", "generic", ["1"])]


def test_chat_exports_become_looms(spark, tmp_path):
    from skein.sources import exports

    said = lambda i, sender, text, **more: {"uuid": i, "sender": sender, "text": text} | more
    chats = [{"uuid": "x", "name": "one", "chat_messages": [said("m1", "human", "hi"), said("m2", "assistant", "yes", model="big"), 5]}, {"uuid": "y", "chat_messages": [said("m1", "human", "root"), said("m2", "assistant", "a", parent_message_uuid="m1"), said("m3", "assistant", "b", parent_message_uuid="m1")]}, {"uuid": "z"}]
    (tmp_path / "claude.json").write_text(json.dumps(chats))
    placed = looms.export_turns(exports.read_claude_export(spark, str(tmp_path / "claude.json")))
    assert sorted((r.loom, r.place, r.id, r.parent_id, r.role, r.author, r.text) for r in placed.collect()) == [
        ("0:x", 0, "0:x/m1", None, "user", "user", "hi"), ("0:x", 1, "0:x/m2", "0:x/m1", "assistant", "big", "yes"),
        ("1:y", 0, "1:y/m1", None, "user", "user", "root"), ("1:y", 1, "1:y/m2", "1:y/m1", "assistant", "assistant", "a"), ("1:y", 2, "1:y/m3", "1:y/m1", "assistant", "assistant", "b"),
    ]
    node = lambda parent, role=None, text=None: {"parent": parent} | ({"message": {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}}} if role else {})
    tree = [{"id": "t", "title": "T", "mapping": {"root": node(None), "sys": node("root"), "a": node("sys", "user", "ask"), "gap": node("a"), "b": node("gap", "assistant", "one"), "c": node("a", "assistant", "two"), "d": node("c", "user", "more")}}]
    (tmp_path / "chatgpt.json").write_text(json.dumps(tree))
    placed = looms.mapping_turns(exports.read_chatgpt_export(spark, str(tmp_path / "chatgpt.json")))
    assert [(r.place, r.id, r.parent_id, r.text) for r in placed.orderBy("place").collect()] == [(0, "0:t/a", None, "ask"), (1, "0:t/b", "0:t/a", "one"), (2, "0:t/c", "0:t/a", "two"), (3, "0:t/d", "0:t/c", "more")]
    written = looms.snapshots(placed, {"source": "chat"})
    assert values(looms.verified(written), "loom", "turns", "problems") == [("0:t", 4, "")]


def test_threads_and_logs_become_looms(spark):
    posts = spark.createDataFrame([("2", "1", "2026-01-02", "friend", "reply"), ("1", None, "2026-01-01", None, "first"), ("3", "gone", "2026-01-03", "Me", "lost"), ("4", "2", "2026-01-01", "me", "early")], "id string, parent_id string, created_at string, handle string, text string")
    placed = looms.thread_turns(posts, "me", "My Name")
    assert sorted((r.loom, r.place, r.id, r.parent_id, r.role, r.author) for r in placed.collect()) == [("1", 0, "1", None, "user", "My Name"), ("1", 1, "2", "1", "assistant", "friend"), ("1", 2, "4", "2", "user", "My Name"), ("3", 0, "3", None, "user", "My Name")]
    from skein.operators import log

    line = lambda i, kind, parents, payload: json.dumps({"v": 1, "id": i, "kind": f"log/{kind}", "at": "2026-01-01T00:00:00Z", "author": {"actor": "x"}, "parents": parents, "payload": payload})
    lines = [line("L", "loom", [], {"meta": {"profile": "conversation"}}), line("b", "turn", ["a"], {"payload": {"text": "two"}, "meta": {"role": "assistant", "author": "m"}}), line("a", "turn", ["L"], {"payload": {"text": "one"}, "meta": {"role": "user", "author": "u"}}), line("n", "note", ["a"], {})]
    events = log.eligible(log.classified(spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line long, text string")))
    assert sorted((r.loom, r.place, r.id, r.parent_id, r.text, r.author) for r in looms.folded(events, "log/loom", "log/turn").collect()) == [("L", 0, "a", None, "one", "u"), ("L", 1, "b", "a", "two", "m")]
