"""A log as a Markdown document: a golden document, byte for byte, whatever the order of the lines."""

import json
import random

import pytest

from skein.operators import log
from skein.sinks import markdown

A, B, C, D, E, F, G, H, I, J, K, L, M = (f"5eed00{i:02x}-0000-7000-8000-0000000000{i:02x}" for i in range(1, 14))


def event(i, kind, at, actor, parents, payload, **more):
    author = {"actor": actor} | ({"operator": "mira", "via": "loomkit@2"} if actor == "model-a" else {})
    return json.dumps({"v": 1, "id": i, "kind": f"log/{kind}" if "/" not in kind else kind, "at": f"2026-05-01T10:{at}Z", "author": author, "parents": parents, "payload": payload} | more, separators=(",", ":"), ensure_ascii=False)


LINES = [
    event(A, "artifact", "00:00", "mira", [], {"text": "The lamp above the harbour went out."}),
    event(B, "artifact", "00:09", "model-a", [A], {"text": "Nobody rowed that night, and the tide kept count.", "n": 0}),
    event(C, "artifact", "00:10", "model-a", [A], {"text": "Inland, the dogs heard it first.", "n": 1}),
    event(D, "annotation", "00:11", "judge-3", [B], {"label": "score", "value": 0.75}),
    event(E, "annotation", "00:15", "mira", [B, C], {"label": "selection", "chosen": [B], "shown": [B, C], "basis": "by hand"}),
    event(F, "artifact", "01:00", "model-a", [C], {"text": "# No heading, a dog's remark.\n\n```\nnot a fence\n```\n\nThe yard went quiet.", "n": 0}),
    event(G, "artifact", "02:00", "mira", [B], {"text": "At dawn somebody lit it again."}),
    event(H, "artifact", "02:05", "model-a", [B], {"text": "An ending that was taken back.", "n": 1}),
    event(I, "tombstone", "03:00", "mira", [H], {"reason": "taken back"}, critical=True),
    event(J, "tool/tide", "04:00", "gauge-9", [G], {"metres": 41, "station": "N `7`", "odd": 1.0}),
    event(K, "annotation", "05:00", "mira", [G], {"label": "decision", "note": "keep"}),
    event(L, "artifact", "06:00", "model-a", [A], {"text": "One account."}),
    event(L, "artifact", "06:00", "model-a", [A], {"text": "Another account."}),
    event(M, "artifact", "07:00", "mira", [L], {"text": "A reply whose parent is disputed."}),
]
GOLDEN = f"""# harbour.log

*12 events across 14 lines · earliest 2026-05-01T10:00:00Z → latest 2026-05-01T10:07:00Z · main thread: 4 steps to leaf `5eed000a` (selections-first path; other leaves: `5eed0006`, `5eed0008`, `5eed000d`)*

## Thread

**mira** · 2026-05-01T10:00:00Z · `5eed0001`

The lamp above the harbour went out.

**model-a** (operator: mira, via loomkit@2) · 2026-05-01T10:00:09Z · `5eed0002`[^alt-1]

Nobody rowed that night, and the tide kept count.

> **score 0.75** — judge-3, 2026-05-01T10:00:11Z · `5eed0004`
> **selected** over 1 alternative — mira, 2026-05-01T10:00:15Z ("by hand") · `5eed0005`

**mira** · 2026-05-01T10:02:00Z · `5eed0007`[^alt-2]

At dawn somebody lit it again.

> **decision** — mira, 2026-05-01T10:05:00Z · `{{"note":"keep"}}` · `5eed000b`

**gauge-9** · 2026-05-01T10:04:00Z · `5eed000a`

```json
{{
  "metres": 41,
  "station": "N `7`",
  "odd": 1
}}
```

## Not on the main thread

### Branching from step 1 — branch `5eed0003`

*Not taken; that thread continued with `5eed0002`.*

**model-a** (operator: mira, via loomkit@2) · 2026-05-01T10:00:10Z · `5eed0003`

Inland, the dogs heard it first.

> **shown, not chosen** — mira, 2026-05-01T10:00:15Z ("by hand") · `5eed0005`

**model-a** (operator: mira, via loomkit@2) · 2026-05-01T10:01:00Z · `5eed0006`

\\# No heading, a dog's remark.

\\```
not a fence
\\```

The yard went quiet.

### Detached thread `5eed000d`

*Earlier context unavailable due to conflict on `5eed000c`; the thread below starts mid-conversation.*

**mira** · 2026-05-01T10:07:00Z · `5eed000d`

A reply whose parent is disputed.

[^alt-1]: A deeper alternative branch starts here, by model-a (2 events on its longest path) — see "Not on the main thread", branch `5eed0003`.

[^alt-2]: Alternative at this point (not taken), by model-a (operator: mira, via loomkit@2), 2026-05-01T10:02:05Z · `5eed0008`:
    *(content withheld — retracted by tombstone `5eed0009`)*

## Diagnostics

- 14 lines: 12 accepted, 0 nonconforming, 0 garbage, 0 damaged, 2 conflict variants.
- **Conflict** on id `{L}`: 2 variants seen; none is shown above.
- **Unavailable due to conflict**: `{L}`.
- **Withheld** `5eed0008` — payload suppressed by a critical retraction; envelope shown above.

<details>
<summary>Event ids (12 view-eligible events)</summary>

| short | kind | actor | at | full id |
| --- | --- | --- | --- | --- |
| `5eed0001` | log/artifact | mira | 2026-05-01T10:00:00Z | `{A}` |
| `5eed0002` | log/artifact | model-a | 2026-05-01T10:00:09Z | `{B}` |
| `5eed0003` | log/artifact | model-a | 2026-05-01T10:00:10Z | `{C}` |
| `5eed0004` | log/annotation | judge-3 | 2026-05-01T10:00:11Z | `{D}` |
| `5eed0005` | log/annotation | mira | 2026-05-01T10:00:15Z | `{E}` |
| `5eed0006` | log/artifact | model-a | 2026-05-01T10:01:00Z | `{F}` |
| `5eed0007` | log/artifact | mira | 2026-05-01T10:02:00Z | `{G}` |
| `5eed0008` | log/artifact | model-a | 2026-05-01T10:02:05Z | `{H}` |
| `5eed0009` | log/tombstone | mira | 2026-05-01T10:03:00Z | `{I}` |
| `5eed000a` | tool/tide | gauge-9 | 2026-05-01T10:04:00Z | `{J}` |
| `5eed000b` | log/annotation | mira | 2026-05-01T10:05:00Z | `{K}` |
| `5eed000d` | log/artifact | mira | 2026-05-01T10:07:00Z | `{M}` |

</details>
"""


def rendered(spark, lines, tmp_path, **more):
    rows = log.classified(spark.createDataFrame([("harbour.log", i + 1, t) for i, t in enumerate(lines)], "file string, line long, text string"))
    chunks = markdown.markdown(rows, "log/annotation", "log/tombstone", **more)
    folder = str(tmp_path / f"doc-{len(list(tmp_path.iterdir()))}")
    markdown.write_markdown(chunks, folder)
    markdown.joined(spark, folder, folder + ".md")
    return open(folder + ".md", encoding="utf-8").read()


def test_golden_document(spark, tmp_path):
    assert rendered(spark, LINES, tmp_path) == GOLDEN
    shuffled = LINES[:]
    random.Random(1).shuffle(shuffled)
    assert rendered(spark, shuffled, tmp_path) == GOLDEN


def test_damage_and_loose_annotations(spark, tmp_path):
    bad = LINES[:6] + [LINES[6][:-1] + f',"digest":"sha256:{"0" * 64}"}}'] + LINES[7:] + ["no event", event("5eed0020-x", "annotation", "08:00", "mira", [A], {"label": "score", "value": "much"}), event("5eed0021-x", "annotation", "08:00", "mira", [G], {"label": "aside"}), event("5eed0022-x", "artifact", "09:00", "mira", ["5eed0023-x"], {"text": "round"}), event("5eed0023-x", "artifact", "09:00", "mira", ["5eed0022-x"], {"text": "and round"})]
    text = rendered(spark, bad, tmp_path, title="T")
    for said in (
        "# T\n",
        "- **Damaged** `harbour.log:7` — sha256 mismatch;",
        "- **Garbage** `harbour.log:15` —",
        "- **Annotation not interpreted** `5eed0020`",
        '> **score (not interpreted)** — mira, 2026-05-01T10:08:00Z · `{"label":"score","value":"much"}` · `5eed0020`',
        "- **Annotation on unrendered target** `5eed0021` — **aside** by mira, 2026-05-01T10:08:00Z, on `5eed0007` (not rendered above)",
        "- **Cycle** through `5eed0022`, `5eed0023` — ancestry",
        "### Not reachable from a root `5eed0022`",
        f"- **Missing parent** `{G}` — referenced",
        "*This thread starts mid-conversation; parent `5eed0007`… is not in this file.*",
    ):
        assert said in text, said
    assert "At dawn somebody lit it again." not in text and text.count("and round") == 1


def test_head_and_empty(spark, tmp_path):
    text = rendered(spark, LINES, tmp_path, head=F)
    assert "main thread: 3 steps to leaf `5eed0006` (head override" in text
    assert text.index("Inland, the dogs") < text.index("## Not on the main thread") < text.index("Nobody rowed") < text.index('"metres": 41')
    with pytest.raises(ValueError, match="no event"):
        rendered(spark, LINES, tmp_path, head="nobody")
    empty = rendered(spark, [], tmp_path, title="nothing")
    assert empty.startswith("# nothing\n\n*0 view-eligible events across 0 lines — nothing renderable as a thread.*\n\n## Thread\n\n*No view-eligible events; nothing to render.*\n\n## Diagnostics\n")


def test_text_of_an_event():
    assert markdown.code_span("a`b``c") == "```a`b``c```" and markdown.code_span("`a") == "`` `a ``"
    assert markdown.prose("   # x\n    # y\n~~~~\nz") == "   \\# x\n    # y\n\\~~~~\nz"
    assert markdown.json_block({"a": "```"}).startswith("````json\n")
