"""Typed content parts: a visitor flattens messages into text with ordered placeholders.

A message's content is a string, or a JSON list of parts, each with a ``type``:

- ``text`` {text};
- ``image`` {uri, width, height}: PATCH x PATCH tiles and two markers;
- ``audio`` {uri, ms}: a token each FRAME_MS and two markers;
- ``document`` {uri, parts}: two markers around its own parts, to any depth.

``flatten`` gives one row a conversation: its turns in order under a role header, each attachment as
``<|kind:n|>`` where n counts the conversation's attachments in reading order, a reference for each
(n, kind, uri, turn, character offset of the placeholder, tokens it expands to) and the token counts.
Text tokens are whitespace words. The only shuffle brings a conversation's turns together.

Defined results: null content is an empty message; content that isn't JSON, or is JSON other than a
list or a string, is taken as plain text; a part of unknown type or that isn't an object becomes
``<|unknown:n|>`` with no tokens and is referenced; missing, negative or odd sizes count as 0 and cost the
markers alone, and a conversation's tokens stop at 2**62; half a surrogate pair becomes U+FFFD; a null uri is ''; very long
texts are kept whole; the turns of null conv_id form one conversation; ties and repeated rows stay, ordered by
(turn, role, content), nulls first; placeholders that occur in a text are escaped as ``<\\|``, so none can be forged; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

PATCH, FRAME_MS, MARKERS = 28, 40, 2
#: More tokens than this are counted as so many.
MOST = 1 << 62
_LONE = re.compile("[\ud800-\udfff]")
REFERENCE = pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("turn", pa.int64()), ("char_offset", pa.int64()), ("tokens", pa.int64())])
SCHEMA = "conv_id long, n_turns int, text string, text_tokens long, media_tokens long, attachments array<struct<ordinal int, kind string, uri string, turn long, char_offset long, tokens long>>"


def _number(x: object) -> int:
    if isinstance(x, bool) or not isinstance(x, int | float) or not x > 0:
        return 0
    return MOST if math.isinf(x) else int(x)


def _clean(s: object) -> str:
    """JSON can hold halves of surrogate pairs, which no UTF-8 text can."""
    return (s if s.isascii() else _LONE.sub("\ufffd", s)) if isinstance(s, str) else ""


class Visitor:
    """Walks the parts of one conversation with a stack of its own, so depth has no limit but the JSON parser's."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0
        self.words = 0
        self.media = 0
        self.refs: list[dict] = []
        self.turn: int | None = None

    def put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def text(self, s: object) -> None:
        s = _clean(s)
        self.words += len(s.split())
        self.put(s.replace("<|", "<\\|"))

    def attach(self, kind: str, part: object, tokens: int) -> None:
        uri = _clean(part.get("uri")) if isinstance(part, dict) else ""
        tokens = min(tokens, MOST - self.media)
        self.refs.append({"ordinal": len(self.refs) + 1, "kind": kind, "uri": uri, "turn": self.turn, "char_offset": self.size, "tokens": tokens})
        self.media += tokens
        self.put(f"<|{kind}:{len(self.refs)}|>")

    def visit_text(self, part: dict) -> list:
        self.text(part.get("text"))
        return []

    def visit_image(self, part: dict) -> list:
        w, h = _number(part.get("width")), _number(part.get("height"))
        self.attach("image", part, -(-w // PATCH) * -(-h // PATCH) + MARKERS)
        return []

    def visit_audio(self, part: dict) -> list:
        self.attach("audio", part, -(-_number(part.get("ms")) // FRAME_MS) + MARKERS)
        return []

    def visit_document(self, part: dict) -> list:
        self.attach("document", part, MARKERS)
        inner = part.get("parts")
        return [*(inner if isinstance(inner, list) else []), None]

    def content(self, content: str | None) -> None:
        if content is None:
            return
        value: object = content
        if content[:1] in '["' and content:
            try:
                value = json.loads(content)
            except (ValueError, RecursionError):
                value = content
        if not isinstance(value, list):
            self.text(value if isinstance(value, str) else content)
            return
        stack = value[::-1]
        ends = object()
        while stack:
            part = stack.pop()
            if part is ends:
                self.put("<|/document|>")
                continue
            visit = getattr(self, f"visit_{part['type']}", None) if isinstance(part, dict) and part.get("type") in ("text", "image", "audio", "document") else None
            if visit is None:
                self.attach("unknown", part, 0)
                continue
            inner = visit(part)
            if inner:
                stack.append(ends)
                stack += inner[-2::-1]

    def message(self, turn: int | None, role: str | None, content: str | None) -> None:
        self.turn = turn
        self.put("<|start|>" + (role or "").replace("<|", "<\\|") + "\n")
        self.content(content)
        self.put("<|end|>\n")


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = []
        for turns in b.column(1).to_pylist():
            v = Visitor()
            for t in turns:
                v.message(t["turn"], t["role"], t["content"])
            done.append((len(turns), "".join(v.out), v.words, v.media, v.refs))
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(REFERENCE)), strict=True)]], ["conv_id", "n_turns", "text", "text_tokens", "media_tokens", "attachments"])


def flatten(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, content -> SCHEMA, one row a conversation."""
    x = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("content").cast("string").alias("content")).alias("t"))
    return x.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).mapInArrow(_flatten, SCHEMA)


def typed(conversations: DataFrame) -> DataFrame:
    """The table has plain texts only; attachments are put into them by number, texts staying whole."""
    c, t, text = F.col("conv_id"), F.col("turn"), F.coalesce(F.col("text"), F.lit(""))
    head, rest = F.substring_index(text, "\n", 1), F.expr("substr(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\n', 1)) + 1)")
    key = F.concat(c.cast("string"), F.lit("/"), t.cast("string"))

    def part(kind: str, **fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in fields.items()]))

    image = part("image", uri=F.concat(F.lit("img://"), key), width=100 + c * 37 % 900, height=80 + t * 53 % 700)
    audio = part("audio", uri=F.concat(F.lit("aud://"), key), ms=500 + (c * 911 + t * 77) % 20000)
    inner = F.concat_ws(",", part("text", text=rest), F.when((c + t) % 3 == 0, part("image", uri=F.concat(F.lit("fig://"), key), width=F.lit(56), height=56 + c % 100)))
    document = F.concat(F.lit('{"type":"document","uri":"doc://'), key, F.lit('","parts":['), inner, F.lit("]}"))
    parts = F.concat_ws(",", part("text", text=head), F.when((c + t) % 4 == 1, image), F.when((c + 2 * t) % 5 == 2, audio), F.when(t % 3 == 2, document).otherwise(part("text", text=rest)))
    content = F.when((c + t) % 7 == 3, text).otherwise(F.concat(F.lit("["), parts, F.lit("]")))
    return conversations.select("conv_id", "turn", "role", content.alias("content"))


def op2_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, flattened; the references as one string each."""
    x = flatten(typed(read(spark, sf_dir, "conversations")))
    refs = F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["ordinal"], a["kind"], a["uri"], a["turn"], a["char_offset"], a["tokens"])), ",")
    return x.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "text", "text_tokens", "media_tokens", refs.alias("attachments"))


def chat_sql() -> str:
    """DuckDB SQL of op2's rows: pieces with prefix sums instead of a visitor."""
    return """
WITH base AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS text, CAST(conv_id AS VARCHAR) || '/' || turn AS k,
  split_part(coalesce(text, ''), chr(10), 1) AS head FROM conversations),
b AS (SELECT *, substr(text, length(head) + 1) AS rest, (c + t) % 7 = 3 AS plain FROM base),
pieces AS (
  SELECT c, t, 0 AS p, '' AS kind, '' AS uri, 0 AS tokens, '<|start|>' || role || chr(10) AS s, 0 AS w FROM b
  UNION ALL SELECT c, t, 1, '', '', 0, replace(CASE WHEN plain THEN text ELSE head END, '<|', '<\\|'), len(regexp_extract_all(CASE WHEN plain THEN text ELSE head END, '[^ \\n\\t\\r]+')) FROM b
  UNION ALL SELECT c, t, 2, 'image', 'img://' || k, CAST(ceil((100 + c * 37 % 900) / 28.0) * ceil((80 + t * 53 % 700) / 28.0) + 2 AS BIGINT), NULL, 0 FROM b WHERE NOT plain AND (c + t) % 4 = 1
  UNION ALL SELECT c, t, 3, 'audio', 'aud://' || k, CAST(ceil((500 + (c * 911 + t * 77) % 20000) / 40.0) + 2 AS BIGINT), NULL, 0 FROM b WHERE NOT plain AND (c + 2 * t) % 5 = 2
  UNION ALL SELECT c, t, 4, 'document', 'doc://' || k, 2, NULL, 0 FROM b WHERE NOT plain AND t % 3 = 2
  UNION ALL SELECT c, t, 5, '', '', 0, replace(rest, '<|', '<\\|'), len(regexp_extract_all(rest, '[^ \\n\\t\\r]+')) FROM b WHERE NOT plain
  UNION ALL SELECT c, t, 6, 'image', 'fig://' || k, CAST(2 * ceil((56 + c % 100) / 28.0) + 2 AS BIGINT), NULL, 0 FROM b WHERE NOT plain AND t % 3 = 2 AND (c + t) % 3 = 0
  UNION ALL SELECT c, t, 7, '', '', 0, '<|/document|>', 0 FROM b WHERE NOT plain AND t % 3 = 2
  UNION ALL SELECT c, t, 8, '', '', 0, '<|end|>' || chr(10), 0 FROM b),
numbered AS (SELECT *, sum(CASE WHEN kind <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t, p) AS n FROM pieces),
said AS (SELECT *, coalesce(s, '<|' || kind || ':' || CAST(n AS BIGINT) || '|>') AS x FROM numbered),
placed AS (SELECT *, sum(length(x)) OVER (PARTITION BY c ORDER BY t, p) - length(x) AS o FROM said)
SELECT c AS conv_id, count(DISTINCT t) AS n_turns, string_agg(x, '' ORDER BY t, p) AS text, CAST(sum(w) AS BIGINT) AS text_tokens, CAST(sum(tokens) AS BIGINT) AS media_tokens,
  coalesce(string_agg(CAST(n AS BIGINT) || ' ' || kind || ' ' || uri || ' ' || t || ' ' || CAST(o AS BIGINT) || ' ' || tokens, ',' ORDER BY t, p) FILTER (WHERE kind <> ''), '') AS attachments
FROM placed GROUP BY c"""
