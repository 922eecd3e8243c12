"""A log as a Markdown document: an ordered stream of chunks, written as sorted parts."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skein.operators import board as boards
from skein.operators import log, training
from skein.operators.outline import main_rule, outline, placed
from skein.operators.tables import checkpointed

#: What the document calls the ways to its main thread.
RULE_NAMES = {"selection": "selections-first path", "score": "leaderboard rank", "longest": "longest thread", "only": "single path", "override": "head override"}
#: Other leaves that the head of the document names.
NAMED_LEAVES = 6
_CLASSES = ("accepted", "nonconforming", "garbage", "damaged", "conflict-variant")

# -- text of one event (F34) --


def code_span(value: str) -> str:
    """Inline code that outruns any backticks in the value."""
    fence = "`" * (1 + max(map(len, re.findall("`+", value)), default=0))
    pad = " " if value.startswith("`") or value.endswith("`") else ""
    return f"{fence}{pad}{value}{pad}{fence}"


def prose(text: str) -> str:
    """Text with a backslash before what would begin a heading or a fence."""
    return "\n".join(re.sub(r"^( {0,3})(#|```|~~~)", r"\1\\\2", line) for line in text.split("\n"))


def _number(digits: str) -> int | float:
    x = float(digits)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_block(value: object) -> str:
    """A fenced block whose fence outruns any backticks in it."""
    body = json.dumps(value, ensure_ascii=False, indent=2)
    fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
    return f"{fence}json\n{body}\n{fence}"


def facts(line: str) -> dict[str, str | None]:
    """What the document says of an event, from its line. Numbers are written without needless digits; an exponent keeps Python's form."""
    event = json.loads(line, parse_float=_number)
    author, payload = event.get("author") or {}, event.get("payload")
    known = [(k, author[k]) for k in ("operator", "via", "imported_by", "source") if isinstance(author.get(k), str)]
    names = {"operator": "operator: ", "via": "via ", "imported_by": "imported by ", "source": "source "}
    axes = [names[k] + v for k, v in known] + [f"{k}: {compact(author[k])}" for k in sorted(author) if k not in ("actor", *names)]
    fields = payload if isinstance(payload, dict) else {}
    text, label, basis = fields.get("text"), fields.get("label"), fields.get("basis")
    rest = {k: v for k, v in fields.items() if k != "label"}
    is_text = isinstance(text, str)
    quoted = '"' + prose(text).replace("\n", "\n    ") + '"' if is_text else code_span(compact(payload))
    return {
        "axes": f" ({', '.join(axes)})" if axes else "",
        "body": prose(text) if is_text else json_block(payload),
        "quoted": f"    {quoted}",
        "payload": code_span(compact(payload)),
        "label": label if isinstance(label, str) else None,
        "rest": f" · {code_span(compact(rest))}" if rest else "",
        "value": compact(fields.get("value")),
        "basis": "" if "basis" not in fields else f' ("{basis}")' if isinstance(basis, str) else f" (basis: {compact(basis)})",
    }


_FACTS = ("axes", "body", "quoted", "payload", "label", "rest", "value", "basis")


@F.pandas_udf(StructType([StructField(n, StringType()) for n in _FACTS]))
def _facts(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts(x) for x in lines], columns=list(_FACTS))


def span(value: Column) -> Column:
    """code_span as an expression."""
    runs = F.transform(F.regexp_extract_all(value, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(value.startswith("`") | value.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, value, pad, fence)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def _cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


# -- the document --

#: What chunks are sorted by: the part of the document, then section (or number, or group), step, kind of chunk, and id.
ORDER = ("part", "a", "b", "c", "key", "line")


def _chunks(rows: DataFrame, part: int, a: Column, b: Column, c: int | Column, key: Column, text: Column, line: Column | None = None) -> DataFrame:
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return rows.select(F.lit(part).alias("part"), as_long(a).alias("a"), as_long(b).alias("b"), as_long(c).alias("c"), F.coalesce(key, F.lit("")).alias("key"), as_long(line if line is not None else F.lit(0)).alias("line"), text.alias("text"))


def markdown(rows: DataFrame, annotation: str, tombstone: str, title: str | None = None, head: str | None = None) -> DataFrame:
    """part, a, b, c, key, line, text: the chunks of the document; sorted by ORDER and joined by line feeds they are it, without its last line feed.

    rows: classified lines (operators.log), of one log or several. No chunk holds more
    than one event, and an event's annotations are chunks of their own, so a log of any
    size, a thread of any length and an event with any number of annotations are only
    sorted. head takes the way to that event for the main thread. An event stands below
    its first parent on a thread; what its other parents are is in its line. Damaged,
    garbage and conflicting lines are named and not shown; a log without events says so.
    """
    events = log.eligible(rows)
    notes = checkpointed(boards.annotations(events, annotation))
    scores, selections = boards.scores(notes), boards.selections(notes)
    ranks = checkpointed(training.leaderboard(scores, selections))
    nodes = placed(events, annotation, tombstone)
    ranked = ranks.select(F.col("target").alias("id"), F.col("selected_count").alias("selected"), F.when(F.col("score_count") > 0, F.col("rank")).alias("rank"))
    where = checkpointed(outline(nodes, ranked, head))
    crowded = events.groupBy(F.substring("id", 1, 8).alias("p")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("p").alias("__p"), F.lit(True).alias("__c"))

    def short(df: DataFrame, column: str, name: str) -> DataFrame:
        """Adds name, the column's id by its first characters where one event only begins so, as code."""
        out = df.join(crowded, F.substring(column, 1, 8) == F.col("__p"), "left")
        return out.withColumn(name, span(F.when(F.col("__c"), F.col(column)).otherwise(F.substring(column, 1, 8)))).drop("__p", "__c")

    told = checkpointed(short(events.withColumn("f", _facts("text")), "id", "code").select("id", "kind", "at", "actor", "suppressed", "critical", "parents", "code", *(F.col(f"f.{n}").alias(n) for n in _FACTS)))
    on, beside = where.where("role = 'thread'"), where.where("role != 'thread'")
    steps = on.join(told.drop("kind"), "id")

    # why a payload is withheld: in order, the critical events that name it
    naming = events.where("critical").select(F.explode(F.array_distinct("parents")).alias("target"), "id", "kind")
    naming = short(naming, "id", "by").select("target", "id", F.concat(F.when(F.col("kind") == tombstone, "tombstone ").otherwise("critical event "), "by").alias("said"))
    named = naming.groupBy("target").agg(F.concat(F.lit("*(content withheld — retracted by "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "said"))), lambda x: x["said"]), ", "), F.lit(")*")).alias("withheld"))
    withheld = lambda df: df.join(named, df["id"] == named["target"], "left").drop("target")

    # -- annotations as quotes, under what they are about
    quotes = checkpointed(_quotes(notes, told, annotation))
    quoted = lambda rows: quotes.join(rows.select(F.col("id").alias("target"), "section", "place", "number"), "target")

    # -- threads
    marks = beside.select("section", "place", "number").groupBy("section", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda n: F.concat(F.lit("[^alt-"), n.cast("string"), F.lit("]"))), "").alias("marks"))
    steps = withheld(steps.join(marks, ["section", "place"], "left"))
    line = F.concat(F.lit("**"), F.coalesce("actor", F.lit("")), F.lit("**"), "axes", F.lit(" · "), F.coalesce("at", F.lit("")), F.lit(" · "), "code", F.coalesce("marks", F.lit("")))
    shown = F.when(F.col("suppressed"), F.col("withheld")).otherwise(F.col("body"))
    main, others = F.lit(1), F.lit(2)
    of_section = lambda: F.when(F.col("section") == 0, main).otherwise(others)
    threads = _chunks(steps, 0, F.col("section"), F.col("place"), 1, F.lit(""), F.concat(line, F.lit("\n\n"), shown, F.lit("\n"))).withColumn("part", F.when(F.col("a") == 0, main).otherwise(others))
    asked = quoted(on)
    under = _chunks(asked, 0, F.col("section"), F.col("place"), 2 + F.col("bucket"), F.col("annotation"), F.col("said")).withColumn("part", F.when(F.col("a") == 0, main).otherwise(others))
    after = _chunks(asked.select("section", "place").distinct(), 0, F.col("section"), F.col("place"), 9, F.lit(""), F.lit("")).withColumn("part", F.when(F.col("a") == 0, main).otherwise(others))

    # -- heads of sections, and what is missing before them
    starts = on.where("place = 0")
    branch = short(short(short(starts, "id", "own"), "parent_id", "from"), "instead", "went").join(on.where("section = 0").select(F.col("id").alias("parent_id"), F.col("place").alias("step")), "parent_id", "left")
    fork = F.concat(F.lit("### Branching from "), F.when(F.col("step").isNotNull(), F.concat(F.lit("step "), (F.col("step") + 1).cast("string"))).otherwise(F.col("from")), F.lit(" — branch "), "own", F.lit("\n\n*Not taken; that thread continued with "), "went", F.lit(".*\n"))
    named_kind = F.when(F.col("kind") == "root", "### Separate root ").when(F.col("kind") == "detached", "### Detached thread ").otherwise("### Not reachable from a root ")
    titles = _chunks(branch.where("section > 0"), 2, F.col("section"), F.lit(0), -9, F.lit(""), F.when(F.col("kind") == "branch", fork).otherwise(F.concat(named_kind, "own", F.lit("\n"))))
    conflicts = checkpointed(rows.where("class = 'conflict-variant'").groupBy("id").agg(F.count("*").alias("lines"), F.countDistinct("body_digest").alias("variants")))
    lost = starts.join(events.select("id", F.posexplode("parents").alias("pos", "parent")), "id").join(events.select(F.col("id").alias("parent")), "parent", "left_anti")
    lost = short(lost.join(conflicts.select(F.col("id").alias("parent"), F.lit(True).alias("conflict")), "parent", "left"), "parent", "by")
    stopped = F.concat(F.lit("*Earlier context unavailable due to conflict on "), "by", F.lit("; the thread below starts mid-conversation.*"))
    missing = F.concat(F.lit("*This thread starts mid-conversation; parent "), span(F.substring("parent", 1, 8)), F.lit("… is not in this file.*"))
    notices = _chunks(lost, 0, F.col("section"), F.lit(0), F.when(F.col("conflict"), -3).otherwise(-2), F.lit(""), F.when(F.col("conflict"), stopped).otherwise(missing), F.col("pos")).withColumn("part", F.when(F.col("a") == 0, main).otherwise(others))
    gap = _chunks(lost.select("section").distinct(), 0, F.col("section"), F.lit(0), -1, F.lit(""), F.lit("")).withColumn("part", F.when(F.col("a") == 0, main).otherwise(others))

    # -- footnotes
    alone = withheld(beside.where("role = 'footnote'").join(told.drop("kind"), "id"))
    mark = F.concat(F.lit("[^alt-"), F.col("number").cast("string"), F.lit("]: "))
    text = F.concat(mark, F.lit("Alternative at this point (not taken), by "), F.coalesce("actor", F.lit("")), "axes", F.lit(", "), F.coalesce("at", F.lit("")), F.lit(" · "), "code", F.lit(":\n"), F.when(F.col("suppressed"), F.concat(F.lit("    "), "withheld")).otherwise(F.col("quoted")))
    single = _chunks(alone, 3, F.col("number"), F.lit(0), 0, F.lit(""), text)
    about = quoted(beside.where("role = 'footnote'"))
    dashed = _chunks(about, 3, F.col("number"), F.lit(1), F.col("bucket"), F.col("annotation"), F.concat(F.lit("    — "), F.substring("said", 3, 2**31 - 1)))
    stub = beside.where("role = 'stub'").join(told.select("id", "actor", "code"), "id")
    text = F.concat(mark, F.lit("A deeper alternative branch starts here, by "), F.coalesce("actor", F.lit("")), F.lit(" ("), plural(F.col("below") + 1, "event"), F.lit(' on its longest path) — see "Not on the main thread", branch '), "code", F.lit("."))
    stubs = _chunks(stub, 3, F.col("number"), F.lit(0), 0, F.lit(""), text)
    ends = _chunks(beside, 3, F.col("number"), F.lit(2), 0, F.lit(""), F.lit(""))

    # -- id table
    text = F.concat(F.lit("| "), "code", F.lit(" | "), _cell(F.col("kind")), F.lit(" | "), _cell(F.col("actor")), F.lit(" | "), F.coalesce("at", F.lit("")), F.lit(" | "), span(F.col("id")), F.lit(" |"))
    table = _chunks(told, 6, F.lit(1), F.lit(0), 0, F.col("id"), text)

    found = [threads, under, after, titles, notices, gap, single, dashed, stubs, ends, table]
    found += _frame(rows, events, where, told, nodes, title, main_rule(where), short)
    found += _diagnostics(rows, events, conflicts, notes, quotes, where, told, annotation, short)
    return functools.reduce(DataFrame.unionByName, found)


def _quotes(notes: DataFrame, told: DataFrame, annotation: str) -> DataFrame:
    """target, annotation, bucket (scores, selections, others, malformed), said: a quote for each annotation and target."""
    n = notes.select("id", "state", "chosen", "targets", F.explode(F.array_distinct(F.when(F.col("state").isin("score", "selection"), F.col("targets")).otherwise(F.col("parents")))).alias("target"))
    n = n.join(told.select("id", "code", "actor", "at", "label", "rest", "value", "basis", "payload"), "id")
    by = lambda *more: F.concat(F.lit(" — "), F.coalesce("actor", F.lit("")), F.lit(", "), F.coalesce("at", F.lit("")), *more, F.lit(" · "), "code")
    over = F.size(F.array_except("targets", "chosen"))
    selected = F.array_contains("chosen", F.col("target"))
    name = F.coalesce("label", F.lit("annotation"))
    said = (
        F.when(F.col("state") == "score", F.concat(F.lit("> **score "), "value", F.lit("**"), by(F.col("basis"))))
        .when((F.col("state") == "selection") & selected, F.concat(F.lit("> **selected** over "), plural(over, "alternative"), by(F.col("basis"))))
        .when(F.col("state") == "selection", F.concat(F.lit("> **shown, not chosen**"), by(F.col("basis"))))
        .when(F.col("state") == "generic", F.concat(F.lit("> **"), name, F.lit("**"), by(F.col("rest"))))
        .otherwise(F.concat(F.lit("> **"), name, F.lit(" (not interpreted)**"), by(F.lit(" · "), F.col("payload"))))
    )
    bucket = F.when(F.col("state") == "score", 0).when(F.col("state") == "selection", 1).when(F.col("state") == "generic", 2).otherwise(3)
    return n.select("target", F.col("id").alias("annotation"), bucket.alias("bucket"), said.alias("said"))


def _row(df: DataFrame, part: int, a: int, text: str, c: int = 0) -> DataFrame:
    return df.sparkSession.createDataFrame([(part, a, 0, c, "", 0, text)], "part int, a long, b long, c long, key string, line long, text string")


def _frame(rows: DataFrame, events: DataFrame, where: DataFrame, told: DataFrame, nodes: DataFrame, title: str | None, rule: str, short) -> list[DataFrame]:
    """Title, summary and headings."""
    count = lambda n, word: f"{n} {word}{'' if n == 1 else 's'}"
    lines = rows.count()
    files = [] if title is not None else [r[0] for r in rows.select(F.col("file").cast("string")).distinct().orderBy("file").limit(10).collect()]
    total, first, last = events.agg(F.count("*"), F.min("at"), F.max("at")).first()
    main = where.where("role = 'thread' and section = 0")
    length = main.count()
    top = [_row(rows, 0, 0, f"# {', '.join(files) if title is None else title}\n")]
    if length:
        end = short(main.orderBy(F.desc("place")).limit(1), "id", "by").first()
        leaves = nodes.join(nodes.select(F.col("parent_id").alias("id")), "id", "left_anti").where(F.col("id") != end["id"])
        some = short(leaves.orderBy("id").limit(NAMED_LEAVES), "id", "by").orderBy("id").collect()
        more = leaves.count() - len(some)
        leaf = f"; other leaves: {', '.join(r['by'] for r in some)}{f' and {more} more' if more else ''}" if some else ""
        top.append(_row(rows, 0, 1, f"*{count(total, 'event')} across {count(lines, 'line')} · earliest {first} → latest {last} · main thread: {count(length, 'step')} to leaf {end['by']} ({RULE_NAMES[rule]}{leaf})*\n"))
        top.append(_row(rows, 0, 2, "## Thread\n"))
    else:
        top.append(_row(rows, 0, 1, f"*{count(total, 'view-eligible event')} across {count(lines, 'line')} — nothing renderable as a thread.*\n"))
        top.append(_row(rows, 0, 2, "## Thread\n\n*No view-eligible events; nothing to render.*\n"))
    if not where.where("section > 0").isEmpty():
        top.append(_row(rows, 2, -1, "## Not on the main thread\n"))
    top.append(_row(rows, 6, 0, f"<details>\n<summary>Event ids ({count(total, 'view-eligible event')})</summary>\n\n| short | kind | actor | at | full id |\n| --- | --- | --- | --- | --- |"))
    top.append(_row(rows, 6, 2, "\n</details>"))
    return top


def _diagnostics(rows: DataFrame, events: DataFrame, conflicts: DataFrame, notes: DataFrame, quotes: DataFrame, where: DataFrame, told: DataFrame, annotation: str, short) -> list[DataFrame]:
    """What the document leaves out, and why."""
    classes = {r[0]: r[1] for r in rows.groupBy("class").count().collect()}
    n = [classes.get(c, 0) for c in _CLASSES]
    lines = sum(n)
    head = f"- {lines} line{'' if lines == 1 else 's'}: {n[0]} accepted, {n[1]} nonconforming, {n[2]} garbage, {n[3]} damaged, {n[4]} conflict variants."
    at = span(F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string")))
    bad = rows.where(F.col("class").isin("damaged", "garbage", "nonconforming"))
    told_bad = F.when(F.col("class") == "damaged", F.concat(F.lit("- **Damaged** "), at, F.lit(" — "), "reason", F.lit("; this line is someone's copy of an event and is excluded from the views above."))).when(F.col("class") == "garbage", F.concat(F.lit("- **Garbage** "), at, F.lit(" — "), "reason", F.lit("."))).otherwise(F.concat(F.lit("- **Nonconforming** "), at, F.lit(" — "), "reason", F.lit(" (still shown above).")))
    graph = checkpointed(log.obstacles(events, conflicts.select("id")))
    lost = graph.where("what in ('missing', 'unavailable')")
    said = F.when(F.col("what") == "missing", F.concat(F.lit("- **Missing parent** "), span(F.col("subject")), F.lit(" — referenced but not in this file."))).otherwise(F.concat(F.lit("- **Unavailable due to conflict**: "), span(F.col("subject")), F.lit(".")))
    rings = short(graph.where("what = 'cycle'"), "id", "by")
    ring = rings.groupBy("subject").agg(F.concat(F.lit("- **Cycle** through "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "by"))), lambda x: x["by"]), ", "), F.lit(" — ancestry is not well-founded.")).alias("said"))
    ignored = notes.where("state = 'ignored'").join(told.select("id", "code"), "id")
    # an annotation is placed where one of its targets is shown: on a thread or in a footnote
    placed_ = quotes.join(where.where("role != 'stub'").select(F.col("id").alias("target")), "target", "left_semi").select(F.col("annotation").alias("id")).distinct()
    left = checkpointed(notes.join(placed_, "id", "left_anti").select("id", "parents"))
    targets = short(left.select("id", F.posexplode("parents").alias("pos", "p")), "p", "by").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "by"))), lambda x: x["by"]), ", ").alias("on"))
    loose = left.select("id").join(targets, "id", "left").join(told.select("id", "code", "label", "actor", "at", "payload"), "id")
    lead = F.when(F.col("on").isNotNull(), F.concat(F.lit("on "), "on", F.lit(" (not rendered above)"))).otherwise("with no target")
    unplaced = F.concat(F.lit("- **Annotation on unrendered target** "), "code", F.lit(" — **"), F.coalesce("label", F.lit("annotation")), F.lit("** by "), F.coalesce("actor", F.lit("")), F.lit(", "), F.coalesce("at", F.lit("")), F.lit(", "), lead, F.lit(": "), "payload")
    held = told.where("suppressed")
    clean = not any(n[1:]) and graph.isEmpty() and ignored.isEmpty() and left.isEmpty()
    none = F.lit(0)
    parts = [
        _row(rows, 4, 0, "## Diagnostics\n"),
        _row(rows, 4, 1, head),
        _chunks(bad, 4, F.lit(3), none, 0, F.col("file").cast("string"), told_bad, F.col("line")),
        _chunks(conflicts, 4, F.lit(4), none, 0, F.col("id"), F.concat(F.lit("- **Conflict** on id "), span(F.col("id")), F.lit(": "), plural(F.col("lines"), "variant"), F.lit(" seen; none is shown above."))),
        _chunks(lost, 4, F.lit(5), none, F.when(F.col("what") == "missing", 0).otherwise(2), F.col("subject"), said),
        _chunks(ring, 4, F.lit(5), none, 1, F.col("subject"), F.col("said")),
        _chunks(ignored, 4, F.lit(6), none, 0, F.col("id"), F.concat(F.lit("- **Annotation not interpreted** "), "code", F.lit(" — malformed score/selection payload; shown verbatim where its target is rendered."))),
        _chunks(loose, 4, F.lit(7), none, 0, F.col("id"), unplaced),
        _row(rows, 5, 0, ""),
    ]
    if clean:
        parts.append(_row(rows, 4, 2, "- No dangling parents, cycles, or conflicts on the rendered threads."))
    if not held.isEmpty():
        # one line of the document names them all, so its parts are joined here: withheld ids are few where a log is read
        names = held.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), ", ").alias("names"))
        parts.append(_chunks(names, 4, F.lit(8), none, 0, F.lit(""), F.concat(F.lit("- **Withheld** "), "names", F.lit(" — payload suppressed by a critical retraction; envelope shown above."))))
    return parts


def write_markdown(chunks: DataFrame, path: str) -> None:
    """The document as text files in a folder; one after the other, by name, they are it."""
    chunks.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("text").write.mode("overwrite").option("lineSep", "\n").text(path)


def joined(spark, folder: str, target: str) -> None:
    """The parts of a folder as one file, streamed through Hadoop's file system in buffers; the file appears when it is whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    end = jvm.org.apache.hadoop.fs.Path(target)
    begun = jvm.org.apache.hadoop.fs.Path(f"{target}.part")
    out = end.getFileSystem(conf).create(begun, True)
    try:
        for name in sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    end.getFileSystem(conf).delete(end, False)
    end.getFileSystem(conf).rename(begun, end)
