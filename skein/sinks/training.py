"""Training files of a log: fine-tuning rows, preference pairs, their renderings and the counters of a run."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skein.operators import board as boards
from skein.operators import events as event_texts
from skein.operators import log, training
from skein.operators.closure import paths
from skein.operators.tables import checkpointed
from skein.sinks.store import Store

#: Which counter a gate (operators.training) belongs to.
SFT_GATES = {"ineligible": "ineligible", "suppressed-completion": "suppressed", "no-text": "ineligible", "no-train": "no_train", "partial": "partial_context", "suppressed-context": "suppressed", "no-train-context": "no_train"}
PAIR_GATES = {"ineligible": "ineligible", "suppressed": "ineligible", "no-text": "ineligible", "no-train": "no_train", "different-parent": "context_mismatch", "partial": "partial_context", "suppressed-context": "ineligible", "no-train-context": "no_train"}
_CLASSES = {"accepted": "accepted", "nonconforming": "nonconforming", "garbage": "garbage", "damaged": "damaged", "conflict-variant": "conflict_variants"}


def _category(skip: Column, gates: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for gate, name in gates.items():
        out = F.when(skip == gate, name).otherwise(out)
    return out


def _segment(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("actor", "via", "text")), F.col(f"{prefix}id").alias("event_id"))


class TrainingData:
    """What a log trains with. sft and pairs have a row for each candidate, with skip where a gate refuses it; rows without skip are training rows.

    rows: classified lines (operators.log); annotation: the kind of its annotations. The
    board, the gates and the contexts are those of operators.training; a way from a
    candidate to its root is built only where the candidate passes. paired: whether pairs
    are asked for, too; without it their contexts aren't built.
    """

    def __init__(self, rows: DataFrame, annotation: str, paired: bool = True):
        self.rows, self.with_pairs = rows, paired
        eligible = log.eligible(rows)
        self.notes = checkpointed(boards.annotations(eligible, annotation))
        marked = log.no_train(self.notes.select("id", "label", "parents", F.lit(False).alias("suppressed")))
        text = event_texts.artifact_text(F.try_parse_json("payload"))
        events = eligible.join(marked.select(F.col("target").alias("id"), F.lit(True).alias("marked")), "id", "left")
        via = F.get_json_object(F.col("text"), "$.author.via")
        self.events = checkpointed(events.select("id", F.get("parents", F.lit(0)).alias("parent"), "parents", via.alias("via"), "actor", "at", "kind", F.coalesce("marked", F.lit(False)).alias("marked"), "suppressed", text.alias("text")))
        self.scores, self.selections = boards.scores(self.notes), boards.selections(self.notes)
        self.board = checkpointed(training.leaderboard(self.scores, self.selections))
        # what no event continues and no annotation judges, as most annotations, lies on nobody's way
        judged = self.board.select(F.col("target").alias("id")).unionByName(self.selections.select(F.explode("chosen").alias("id")))
        on = self.events.where("parent is not null").select(F.col("parent").alias("id")).unionByName(judged).distinct()
        faults, jumps = training.context_faults(self.events.select("id", "parent", "suppressed", "marked").join(on, "id", "left_semi"))
        self.faults = checkpointed(faults)
        self._contexts(jumps)

    def _contexts(self, jumps: list[DataFrame]) -> None:
        """id, prompt, context_events of the candidates that pass every gate."""
        self.gated = checkpointed(training.sft(self.events, self.board, self.faults).select("target", "weight", "skip"))
        wanted = self.gated.where("skip is null").select(F.col("target").alias("id"))
        if self.with_pairs:
            self.paired = checkpointed(training.preferences(self.events, self.selections, self.faults).select("selection", "chosen", "rejected", "skip"))
            wanted = wanted.unionByName(self.paired.where("skip is null").select(F.col("chosen").alias("id")))
        wanted = wanted.distinct()
        way = paths(wanted.select(F.col("id").alias("node")), jumps).where("distance > 0")
        said = self.events.where("text is not null and not suppressed").withColumnRenamed("id", "at_id")
        steps = way.select("node", "distance", F.col("at").alias("at_id")).join(said, "at_id").withColumn("id", F.col("at_id"))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), _segment().alias("s"))))
        prompts = steps.groupBy(F.col("node").alias("context")).agg(F.transform(ordered, lambda x: x["s"]).alias("prompt"))
        none = F.array().cast(prompts.schema["prompt"].dataType)
        prompts = wanted.select(F.col("id").alias("context")).join(prompts, "context", "left").withColumn("prompt", F.coalesce("prompt", none))
        self.prompts = checkpointed(prompts.withColumn("context_events", F.transform("prompt", lambda s: s["event_id"])))

    def _files(self, rows: DataFrame, key: Sequence[str], ids: Column) -> DataFrame:
        """Adds files: the sorted files that hold any of the ids."""
        named = rows.select(*key, F.explode(ids).alias("id")).join(self.rows.where("id is not null").select("id", F.col("file").cast("string").alias("file")), "id")
        return rows.join(named.groupBy(*key).agg(F.array_sort(F.collect_set("file")).alias("files")), list(key), "left")

    def sft(self) -> DataFrame:
        """target, skip, category; prompt, completion, weight, meta of training rows."""
        per = self.scores.groupBy("target").agg(F.array_sort(F.collect_list("annotation")).alias("score_events"))
        shown = self.selections.select(F.explode("shown").alias("target"), "id").groupBy("target").agg(F.array_sort(F.collect_set("id")).alias("selection_events"))
        out = self.gated.join(self.board.drop("mean", "rank"), "target", "left").join(per, "target", "left").join(shown, "target", "left")
        no_ids = F.array().cast("array<string>")
        out = out.withColumns({c: F.coalesce(c, no_ids) for c in ("score_events", "selection_events")})
        out = out.join(self.prompts, F.col("target") == F.col("context"), "left")
        out = out.join(self.events.select(F.col("id").alias("target"), "actor", "via", "text", "at"), "target", "left").withColumn("id", F.col("target"))
        out = self._files(out, ["target"], F.when(F.col("skip").isNull(), F.array_distinct(F.concat(F.array("target"), "context_events", "score_events", "selection_events"))))
        meta = F.struct(F.col("target").alias("source_event"), "context_events", "score_events", "score_count", "selection_events", "selection_count", "selected_count", "at", "files")
        shown_ = F.col("skip").isNull()
        return out.select("target", "skip", _category(F.col("skip"), SFT_GATES).alias("category"), F.when(shown_, F.col("prompt")).alias("prompt"), F.when(shown_, _segment()).alias("completion"), "weight", F.when(shown_, meta).alias("meta"))

    def pairs(self) -> DataFrame:
        """selection_event, chosen_event, rejected_event, skip, category; prompt, chosen, rejected, meta of training pairs."""
        if not self.with_pairs:
            raise ValueError("pairs weren't asked for")
        out = self.paired.withColumnsRenamed({"selection": "selection_event", "chosen": "chosen_event", "rejected": "rejected_event"})
        judged = self.notes.select(F.col("id").alias("selection_event"), F.parse_json(F.get_json_object("text", "$.author")).alias("judge"), F.try_parse_json(F.to_json(F.try_variant_get(F.parse_json("text"), "$.payload.basis", "variant"))).alias("basis"))
        out = out.join(judged, "selection_event").join(self.prompts, F.col("chosen_event") == F.col("context"), "left")
        for side in ("chosen", "rejected"):
            own = self.events.select(F.col("id").alias(f"{side}_event"), *(F.col(c).alias(f"{side}_{c}") for c in ("id", "actor", "via", "text")))
            mean = self.board.select(F.col("target").alias(f"{side}_event"), F.col("mean").alias(f"{side}_score_mean"))
            out = out.join(own, f"{side}_event", "left").join(mean, f"{side}_event", "left")
        key = ["selection_event", "chosen_event", "rejected_event"]
        out = self._files(out, key, F.when(F.col("skip").isNull(), F.array_distinct(F.concat(F.array(*key), "context_events"))))
        meta = F.struct(*key, "context_events", "judge", "basis", "chosen_score_mean", "rejected_score_mean", "files")
        shown = F.col("skip").isNull()
        return out.select(*key, "skip", _category(F.col("skip"), PAIR_GATES).alias("category"), F.when(shown, F.col("prompt")).alias("prompt"), F.when(shown, _segment("chosen_")).alias("chosen"), F.when(shown, _segment("rejected_")).alias("rejected"), F.when(shown, meta).alias("meta"))


def plain(rows: DataFrame, sides: Sequence[str]) -> DataFrame:
    """The rows with texts in place of segments."""
    return rows.withColumns({"prompt": F.array_join(F.transform("prompt", lambda s: s["text"]), "\n\n"), **{s: F.col(f"{s}.text") for s in sides}})


def messages(rows: DataFrame, voice: str) -> DataFrame:
    """The rows with messages in place of prompt: who speaks like the voice (completion or chosen) is the assistant; a completion is the last message."""
    own = F.col(f"{voice}.actor")
    said = F.transform("prompt", lambda s: F.struct(F.when(s["actor"].eqNullSafe(own), "assistant").otherwise("user").alias("role"), s["text"].alias("content")))
    if voice == "completion":
        return rows.withColumn("messages", F.concat(said, F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion.text").alias("content"))))).drop("prompt", "completion")
    return rows.withColumn("messages", said).drop("prompt").withColumns({s: F.col(f"{s}.text") for s in ("chosen", "rejected")})


def write_training(data: TrainingData, folder: str, renderings: Sequence[str] = ()) -> dict[str, int]:
    """Writes sft, preferences, sft_skips, pair_skips, what renderings name (plain, messages) and stats.json; returns the counters.

    Candidates are written once, with the counters taken from the same pass
    (DataFrame.observe): rows, skips by category, lines by class. Raises unless
    rows and skips add up to the candidates.
    """
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    spark, stats = data.rows.sparkSession, {}

    def held(rows: DataFrame, name: str, counters: list[Column]) -> DataFrame:
        seen = Observation(name)
        rows.observe(seen, *counters).write.mode("overwrite").parquet(f"{folder}/.{name}")
        stats.update({k: int(v) for k, v in seen.get.items()})
        return spark.read.schema(rows.schema).parquet(f"{folder}/.{name}")

    skips = lambda what, names: [count(F.col("category") == c, f"{what}_skipped_{c}") for c in sorted(set(names.values()))]
    sft = held(data.sft(), "sft", [F.count(F.lit(1)).alias("candidates"), count(F.col("skip").isNull(), "sft_rows"), *skips("sft", SFT_GATES)])
    pairs = held(data.pairs(), "pairs", [F.count(F.lit(1)).alias("pair_candidates"), count(F.col("skip").isNull(), "preference_rows"), *skips("pairs", PAIR_GATES)])
    for total, rows, what in (("candidates", "sft_rows", "sft"), ("pair_candidates", "preference_rows", "pairs")):
        parts = stats[rows] + sum(v for k, v in stats.items() if k.startswith(f"{what}_skipped_"))
        if stats.pop(total) != parts:
            raise ValueError(f"{what}: rows and skips don't add up to the candidates")
    lines = data.rows.agg(F.count("*").alias("lines_total"), *(count(F.col("class") == c, n) for c, n in _CLASSES.items())).first()
    told = data.events.agg(F.count("*").alias("view_eligible"), count(F.col("suppressed"), "suppressed_payloads")).first()
    stats |= lines.asDict() | told.asDict() | {"annotations_ignored": data.notes.where("state = 'ignored'").count()}

    def lines_of(rows: DataFrame, name: str) -> None:
        rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")

    kept = {"sft": (sft.where("skip is null").select("prompt", "completion", "weight", "meta").orderBy("meta.source_event"), ["completion"], "completion"), "preferences": (pairs.where("skip is null").select("prompt", "chosen", "rejected", "meta").orderBy("meta.selection_event", "meta.chosen_event", "meta.rejected_event"), ["chosen", "rejected"], "chosen")}
    for name, (rows, sides, voice) in kept.items():
        lines_of(rows, name)
        for rendering in sorted(set(renderings)):
            if rendering not in ("plain", "messages"):
                raise ValueError(f"no rendering {rendering}")
            lines_of(plain(rows, sides) if rendering == "plain" else messages(rows, voice), f"{name}.{rendering}")
    lines_of(sft.where("skip is not null").select("target", "skip", "category"), "sft_skips")
    lines_of(pairs.where("skip is not null").select("selection_event", "chosen_event", "rejected_event", "skip", "category"), "pair_skips")
    Store(spark, folder)._write(f"{folder}/stats.json", json.dumps(stats, sort_keys=True, indent=2) + "\n")
    return stats
