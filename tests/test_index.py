"""The search index: extraction, positions, incremental builds, lock, preflight."""

import json
import random

import pytest

from skein.operators import log
from skein.operators.segments import extracted, segments
from skein.sinks import index
from skein.sinks.index import Busy, SearchIndex

UUID = "0197e6a0-4a13-7000-8000-0000000000ac"


def line(i, kind, payload, at="2026-05-01T10:00:00Z"):
    return json.dumps({"v": 1, "id": i, "kind": kind, "at": at, "author": {"actor": "me"}, "parents": [], "payload": payload}, ensure_ascii=False)


def claude(i, text, n, role="user", path="p/s.jsonl", session="s1"):
    return line(i, f"claude/{role}", {"message": {"role": role, "content": text}, "source": {"path": path, "line": n, "sessionId": session}})


def codex(i, kind, body, n, path=f"c/rollout-{UUID}.jsonl"):
    return line(i, f"codex/{kind}", {"payload": body, "source": {"path": path, "line": n}})


def test_extraction(spark):
    b = lambda **k: k
    texts = [
        claude("a1", "plain said", 1),
        claude("a2", [b(type="text", text="one"), b(type="thinking", text="no"), b(type="text", text=""), b(type="text", text="two")], 2, "assistant"),
        claude("a3", [b(type="tool_use", name="t")], 3, "assistant"),
        line("a4", "claude/user", {"message": {"role": "assistant", "content": "x"}, "source": {"path": "p", "line": 1, "sessionId": "s"}}),
        claude("a5", [b(text="no type")], 5),
        claude("a6", [b(type="text", text=5)], 6),
        line("a7", "claude/user", {"message": {"role": "user", "content": "x"}, "source": {"path": "p", "line": 0, "sessionId": "s"}}),
        claude("a8", "x", 8, session=""),
        claude("a9", "named by its file", 9, path=f"p/{UUID}.jsonl", session=""),
        line("a10", "claude/system", {"message": 1}),
        claude("a11", 7, 11),
    ]
    more = [
        codex("c1", "user_message", {"message": "asked", "content": "not this"}, 2),
        codex("c2", "agent_message", {"content": [b(type="output_text", text="answered")]}, 3),
        codex("c3", "message", {"role": "developer", "content": "hidden"}, 4),
        codex("c4", "message", {"role": "assistant", "content": [b(type="input_text", text="in"), b(type="output_text", text="out")]}, 5),
        codex("c5", "message", {"role": "robot", "content": "x"}, 6),
        codex("c6", "session_meta", {"id": "head"}, 1),
        codex("c7", "session_meta", {"id": "later"}, 9),
        codex("c8", "reasoning", {"text": "private"}, 7),
    ]
    rows = [("f1", i + 1, t) for i, t in enumerate(texts)] + [("f2", i + 1, t) for i, t in enumerate(more)] + [("f3", 1, codex("d1", "user_message", {"message": "headless"}, 1))]
    found = extracted(log.classified(spark.createDataFrame(rows, "file string, line long, text string")))
    status = {r.id: (r.status, r.session) for r in found.collect()}
    assert {i for i, (s, _) in status.items() if s == "error"} == {"a4", "a5", "a6", "a7", "a8", "a11", "c5"}
    assert {i for i, (s, _) in status.items() if s == "other"} == {"a3", "a10", "c3", "c6", "c7", "c8"}
    assert status["a9"][1] == UUID and status["c1"][1] == "head" and status["d1"][1] == UUID
    said = sorted((r.event_id, r.segment, r.role, r.text) for r in segments(found).collect())
    assert said == [("a1", 0, "user", "plain said"), ("a2", 0, "assistant", "one"), ("a2", 1, "assistant", "two"), ("a9", 0, "user", "named by its file"), ("c1", 0, "user", "asked"), ("c2", 0, "assistant", "answered"), ("c4", 0, "assistant", "in"), ("c4", 1, "assistant", "out"), ("d1", 0, "user", "headless")]


def found(df):
    return [(r.source, r.line, r.text) for r in df.collect()]


def test_builds_and_searches(spark, tmp_path):
    tree, root = tmp_path / "tree with space+", str(tmp_path / "index")
    (tree / "deep").mkdir(parents=True)
    dealt = random.Random(2)
    said = {}

    def write(name, ids):
        texts = []
        for i in ids:
            text = "".join(dealt.choice("abА😀 \n") for _ in range(dealt.randrange(40)))
            said[i] = (f"{name}.jsonl", len(texts) + 1, text)
            texts.append(claude(f"e{i}", text, len(texts) + 1, path=f"{name}.jsonl"))
        (tree / name).write_text("\n".join(texts) + "\n\n", encoding="utf-8")

    write("a.lync", range(0, 60))
    write("deep/b.lync", range(60, 120))
    (tree / "ignored.txt").write_text("not json")
    index = SearchIndex(spark, root)
    with pytest.raises(ValueError, match="no index"):
        index.find("abc")
    first = index.build(str(tree))
    assert (first["files"], first["added"], first["seen"]) == (2, 2, 120) and first["searchable"] + first["other"] == 120
    plain = lambda q: sorted(v for v in said.values() if q in v[2])
    for query in ("aba", "ab a", "😀А ", "bb\n", "aaaa", "zzz"):
        assert found(index.find(query, 1000)) == plain(query), query
    # only the folders of the query's buckets are read
    plan = index.candidates("ab a", index.manifest())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(trigram" in plan or "In(trigram" in plan

    same = index.build(str(tree))
    assert same["name"] == first["name"] and same["added"] == 0
    write("deep/b.lync", range(120, 150))
    for i in range(60, 120):
        del said[i]
    second = index.build(str(tree))
    assert (second["files"], second["added"], second["kept"], second["seen"]) == (2, 1, 1, 90) and first["pieces"][0] in second["pieces"]
    new = (set(second["pieces"]) - set(first["pieces"])).pop()
    assert spark.read.parquet(f"{root}/{new}/rows").select("file").distinct().collect()[0][0] == "deep/b.lync"
    assert found(index.find("aba", 1000)) == plain("aba")
    (tree / "a.lync").unlink()
    for i in range(60):
        del said[i]
    third = index.build(str(tree), whole=True)
    assert third["files"] == 1 and found(index.find("aba", 1000)) == plain("aba") and len(third["pieces"]) == 1


def test_refusals(spark, tmp_path):
    tree, root = tmp_path / "tree", tmp_path / "index"
    tree.mkdir()
    (tree / "a.lync").write_text(claude("e1", "first text", 1) + "\n")
    index = SearchIndex(spark, str(root))
    index.build(str(tree))
    current = (root / "CURRENT").read_text()
    for bad, said in ((claude("e1", "another text", 1), "bodies"), ("no json", "garbage"), (claude("e2", 5, 1), "content")):
        (tree / "b.lync").write_text(bad + "\n")
        with pytest.raises(ValueError, match=said):
            index.build(str(tree))
        assert (root / "CURRENT").read_text() == current and not (root / "lock").exists()
    (tree / "b.lync").write_text(claude("e1", "first text", 1) + "\n")  # the same event again
    (root / "lock").write_text("someone")
    with pytest.raises(Busy):
        index.build(str(tree))
    (root / "stage-old").mkdir(exist_ok=True)
    assert SearchIndex(spark, str(root), stale_after=-1).build(str(tree))["files"] == 2
    assert not [p for p in root.iterdir() if p.name.startswith("stage-")]
    assert len(found(index.find("first text"))) == 1
    name = (root / "CURRENT").read_text()
    manifest = json.loads((root / name / "manifest.json").read_text())
    (root / name / "manifest.json").write_text(json.dumps(manifest | {"tokenizer": "other"}))
    for p in (root / name).glob(".manifest*.crc"):
        p.unlink()
    with pytest.raises(ValueError, match="another schema or tokenizer"):
        index.find("first")


def test_concurrent_builds(spark, tmp_path):
    """Of builds at the same time one at least is published; the others are told so, and every generation is whole."""
    from concurrent.futures import ThreadPoolExecutor

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.lync").write_text(claude("e1", "some text", 1) + "\n")

    def build(_):
        try:
            return SearchIndex(spark, str(tmp_path / "index")).build(str(tree))["name"]
        except Busy:
            return None

    with ThreadPoolExecutor(3) as pool:
        names = list(pool.map(build, range(3)))
    assert any(names) and found(SearchIndex(spark, str(tmp_path / "index")).find("ome"))[0][2] == "some text"


def test_postings_take_each_text_apart_once(spark, tmp_path, monkeypatch):
    """No order's bounds are sought, which would gather all positions beforehand; rows of one key, short and null texts stay right."""
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda *a: pytest.fail("sampled for ranges"))
    rows = [(1, 0, "abcabc"), (1, 1, "ab"), (2, 0, None), (2, 1, "xxabcab"), (3, 0, "éabc😀abc"), (3, 0, "bcabca"), (4, 0, "ab cabc")]
    index.write_postings(spark.createDataFrame(rows, "fid long, n long, text string"), f"{tmp_path}/p")
    posts = spark.read.schema(index.POSTING).parquet(f"{tmp_path}/p")
    held = {(r.fid, r.n): sorted(r.positions) for r in posts.where("trigram = 'abc'").collect()}
    assert held == {(1, 0): [1, 4], (2, 1): [3], (3, 0): [2, 3, 6], (4, 0): [5]}
    assert sorted(map(tuple, index.phrase_hits(posts, "abcab").collect())) == [(1, 0), (2, 1)]
