"""A tree of session files converted to event files, and searched."""

import json
import stat

import pytest
from pyspark.sql import functions as F

from skein.operators import sessions
from skein.sinks import tree
from skein.sinks.index import SearchIndex


def session(root, name, n, extra=""):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"uuid": f"{name}-{i}", "sessionId": "s1", "timestamp": "2026-05-01T10:00:00Z", "type": "user", "message": {"role": "user", "content": f"said {i} in {name}"}}) for i in range(n)]
    path.write_text("\n".join(lines) + "\n" + extra)


def test_conversion_and_search(spark, tmp_path):
    source, root = tmp_path / "sessions", tmp_path / "events"
    session(source, "a.jsonl", 40)
    session(source, "deep/er/b c+d.jsonl", 3, "\n{broken\n[1]\n")
    (source / "notes.txt").write_text("ignored")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        done = tree.convert_tree(spark, str(source), str(root), sessions.claude_events)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert done == {"files": 2, "converted": 2, "unreadable": {}, "lines": 46, "emitted": 43, "skipped": 2, "blank": 1}
    written = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert written == ["a.lync", "deep/er/b c+d.lync"]
    events = [json.loads(x) for x in (root / "a.lync").read_text().splitlines()]
    assert [e["payload"]["source"]["line"] for e in events] == list(range(1, 41)) and events[3]["payload"]["message"]["content"] == "said 3 in a.jsonl"
    assert stat.S_IMODE((root / "a.lync").stat().st_mode) == 0o600 and stat.S_IMODE((root / "deep").stat().st_mode) == 0o700
    index = SearchIndex(spark, str(tmp_path / "index"))
    assert index.build(str(root))["searchable"] == 43
    assert [(r.source, r.line) for r in index.find("said 2 in").collect()] == [("a.jsonl", 3), ("deep/er/b c+d.jsonl", 3)]


def test_failures_leave_what_was_there(spark, tmp_path, monkeypatch):
    source, root = tmp_path / "sessions", tmp_path / "events"
    session(source, "a.jsonl", 2)
    tree.convert_tree(spark, str(source), str(root), sessions.claude_events)
    before = (root / "a.lync").read_text()
    session(source, "a.jsonl", 5)
    lines = lambda events: events.withColumn("at", F.lit("some day"))
    with pytest.raises(ValueError, match="nonconforming"):
        tree.convert_tree(spark, str(source), str(root), lambda x: lines(sessions.claude_events(x)))
    assert (root / "a.lync").read_text() == before and [p.name for p in root.iterdir() if not p.name.endswith(".crc")] == ["a.lync"]
    session(source, "b\\c.jsonl", 1)
    session(source, "b/c.jsonl", 1)
    with pytest.raises(ValueError, match="one logical name"):
        tree.convert_tree(spark, str(source), str(root), sessions.claude_events)
    with pytest.raises(ValueError, match="overlap"):
        tree.convert_tree(spark, str(source), str(source / "out"), sessions.claude_events)
    monkeypatch.setattr(tree._Files, "unreadable", lambda self, root, suffix: {f"file:{source}/a.jsonl": "no permission"})
    (source / "b\\c.jsonl").unlink()
    done = tree.convert_tree(spark, str(source), str(root), sessions.claude_events)
    assert done["converted"] == 1 and list(done["unreadable"].values()) == ["no permission"] and (root / "a.lync").read_text() == before and (root / "b" / "c.lync").exists()


def test_codex_sessions(spark, tmp_path):
    source, root = tmp_path / "sessions", tmp_path / "events"
    source.mkdir()
    rows = [{"type": "session_meta", "timestamp": "2026-05-01T10:00:00Z", "payload": {"id": "head", "forked_from_id": "old"}}, {"type": "event_msg", "timestamp": "2026-05-01T10:00:01Z", "payload": {"type": "user_message", "message": "a question"}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "an answer"}]}}]
    (source / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    done = tree.convert_tree(spark, str(source), str(root), sessions.codex_events)
    assert done["emitted"] == 4 and len((root / "r.lync").read_text().splitlines()) == 4
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.build(str(root))
    assert [(r.session, r.role, r.text) for r in index.find("answer").collect()] == [("head", "assistant", "an answer")]
