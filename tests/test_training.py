"""From lines of a log to training files: rows, pairs, renderings and counters."""

import json
from pathlib import Path

from skein.operators import log
from skein.sinks.training import TrainingData, write_training

A, B, C, S, T, N = "a-root", "b-good", "c-other", "s-score", "t-select", "n-mark"


def event(i, kind, parents, payload, actor="mira", **more):
    return json.dumps({"v": 1, "id": i, "kind": f"log/{kind}", "at": "2026-05-01T10:00:00Z", "author": {"actor": actor} | ({"via": "kit"} if actor == "model" else {}), "parents": parents, "payload": payload} | more, separators=(",", ":"))


CLEAN = [
    event(A, "artifact", [], {"text": "Begin."}),
    event(B, "artifact", [A], {"text": "A good turn."}, "model"),
    event(C, "artifact", [A], {"message": {"content": [{"text": "Another"}, {"text": "turn."}]}}, "model"),
    event(S, "annotation", [B], {"label": "score", "value": 0.5}),
    event("s-score2", "annotation", [B], {"label": "score", "value": 1}, "judge"),
    event(T, "annotation", [B, C], {"label": "selection", "chosen": [B], "shown": [B, C], "basis": {"why": ["taste"]}}),
    event("u-score", "annotation", [C], {"label": "score", "value": 0.25}),
]


def made(spark, tmp_path, lines, **more):
    rows = log.classified(spark.createDataFrame([("/x/log", i + 1, t) for i, t in enumerate(lines)], "file string, line long, text string"))
    folder = tmp_path / f"out-{len(list(tmp_path.iterdir()))}"
    stats = write_training(TrainingData(rows, "log/annotation"), str(folder), **more)
    read = lambda name: [json.loads(x) for p in sorted(Path(folder / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert json.loads((folder / "stats.json").read_text()) == stats
    return stats, read


def test_rows_pairs_and_renderings(spark, tmp_path):
    stats, read = made(spark, tmp_path, CLEAN, renderings=["plain", "messages"])
    zero = {k: 0 for k in ("nonconforming", "garbage", "damaged", "conflict_variants", "suppressed_payloads", "sft_skipped_ineligible", "sft_skipped_suppressed", "sft_skipped_no_train", "sft_skipped_partial_context", "pairs_skipped_ineligible", "pairs_skipped_no_train", "pairs_skipped_context_mismatch", "pairs_skipped_partial_context", "annotations_ignored")}
    assert stats == zero | {"lines_total": 7, "accepted": 7, "view_eligible": 7, "sft_rows": 2, "preference_rows": 1} and len(stats) == 19
    good, other = read("sft")
    begin = {"actor": "mira", "via": None, "text": "Begin.", "event_id": A}
    assert good["prompt"] == [begin] and good["completion"] == {"actor": "model", "via": "kit", "text": "A good turn.", "event_id": B} and good["weight"] == 0.75
    assert good["meta"] == {"source_event": B, "context_events": [A], "score_events": [S, "s-score2"], "score_count": 2, "selection_events": [T], "selection_count": 1, "selected_count": 1, "at": "2026-05-01T10:00:00Z", "files": ["/x/log"]}
    assert other["completion"]["text"] == "Another\n\nturn." and other["meta"]["selected_count"] == 0
    (pair,) = read("preferences")
    assert pair["chosen"]["event_id"] == B and pair["rejected"]["event_id"] == C and pair["prompt"] == [begin]
    assert pair["meta"]["judge"] == {"actor": "mira"} and pair["meta"]["basis"] == {"why": ["taste"]} and pair["meta"]["chosen_score_mean"] == 0.75 and pair["meta"]["rejected_score_mean"] == 0.25
    assert read("sft.plain")[0]["prompt"] == "Begin." and read("sft.plain")[0]["completion"] == "A good turn."
    assert read("sft.messages")[0]["messages"] == [{"role": "user", "content": "Begin."}, {"role": "assistant", "content": "A good turn."}]
    assert read("preferences.messages")[0]["messages"] == [{"role": "user", "content": "Begin."}] and read("preferences.messages")[0]["rejected"] == "Another\n\nturn."


def test_skips_are_counted_and_listed(spark, tmp_path):
    cut, _ = made(spark, tmp_path, CLEAN[1:])
    assert (cut["sft_rows"], cut["sft_skipped_partial_context"], cut["preference_rows"], cut["pairs_skipped_partial_context"]) == (0, 2, 0, 1)
    marked, read = made(spark, tmp_path, [*CLEAN, event(N, "annotation", [C], {"label": "no-train"}), event("x-bad", "annotation", [B], {"label": "score", "value": "much"}), "garbage"])
    assert (marked["sft_rows"], marked["sft_skipped_no_train"], marked["pairs_skipped_no_train"], marked["annotations_ignored"], marked["garbage"]) == (1, 1, 1, 1, 1)
    assert read("sft_skips") == [{"target": C, "skip": "no-train", "category": "no_train"}] and len(read("pair_skips")) == 1
    gone, _ = made(spark, tmp_path, [*CLEAN, event("k", "tombstone", [B], {}, critical=True)])
    assert (gone["sft_rows"], gone["sft_skipped_suppressed"], gone["pairs_skipped_ineligible"], gone["suppressed_payloads"]) == (1, 1, 1, 1)
    twice, _ = made(spark, tmp_path, [*CLEAN, event(C, "artifact", [A], {"text": "third account"}, "model")])
    assert (twice["conflict_variants"], twice["sft_rows"], twice["sft_skipped_ineligible"], twice["pairs_skipped_ineligible"]) == (2, 1, 1, 1)
    none, read = made(spark, tmp_path, [])
    assert none["lines_total"] == none["sft_rows"] == 0 and read("sft") == []
