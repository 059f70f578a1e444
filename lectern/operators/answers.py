"""Strict reading of model answers: what is malformed is dropped with its reason, never guessed."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.reads import KNOWLEDGE_TYPES

REQUIRED = ("type", "title", "content", "summary", "confidence")


class AnswerError(ValueError):
    """The whole answer is unusable; a fresh attempt may succeed."""

    retriable = True


def strip_fences(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        lines = text.split("\n")[1:]
        if lines and lines[-1].strip() == "```":
            lines.pop()
        text = "\n".join(lines)
    return text


def _loaded(text: str) -> object:
    try:
        return json.loads(strip_fences(text))
    except (ValueError, RecursionError) as error:
        raise AnswerError(f"not JSON: {error}") from error


def _whole(value: object) -> bool:
    return value is None or (isinstance(value, int) and not isinstance(value, bool))


def extraction(text: str) -> tuple[list[dict], list[str]]:
    """Valid objects, and why others were dropped, by place."""
    data = _loaded(text)
    if not isinstance(data, list):
        raise AnswerError("not an array")
    kept, dropped = [], []
    for i, item in enumerate(data):
        if not isinstance(item, dict):
            dropped.append(f"{i}: not an object")
            continue
        missing = [f for f in REQUIRED if f not in item]
        if missing:
            dropped.append(f"{i}: missing {', '.join(missing)}")
        elif item["type"] not in KNOWLEDGE_TYPES:
            dropped.append(f"{i}: unknown type {item['type']!r}")
        elif isinstance(item["confidence"], bool) or not isinstance(item["confidence"], (int, float)):
            dropped.append(f"{i}: confidence is not a number")
        elif not all(_whole(item.get(f)) for f in ("section_index", "page", "paragraph")):
            dropped.append(f"{i}: a pointer is not a whole number")
        else:
            kept.append({
                "type": item["type"], "title": str(item["title"]), "content": str(item["content"]), "summary": str(item["summary"]),
                "confidence": float(item["confidence"]), "section_index": item.get("section_index"), "page": item.get("page"), "paragraph": item.get("paragraph"),
            })
    return kept, dropped


def summaries(text: str, sections: int) -> tuple[str, list[str | None]]:
    """The chapter's summary and exactly ``sections`` section summaries: padded with nulls or cut."""
    data = _loaded(text)
    if not isinstance(data, dict):
        raise AnswerError("not an object")
    chapter = data.get("chapter_summary")
    if not isinstance(chapter, str) or not chapter.strip():
        raise AnswerError("chapter_summary is missing")
    raw = data.get("section_summaries")
    raw = [] if raw is None else raw
    if not isinstance(raw, list):
        raise AnswerError("section_summaries is not an array")
    out = [x if isinstance(x, str) and x.strip() else None for x in raw[:sections]]
    return chapter, out + [None] * (sections - len(out))


def claims(text: str) -> list[str]:
    """The claims of a judge's first answer; one bad element spoils the answer."""
    data = _loaded(text)
    if not isinstance(data, list):
        raise AnswerError("not an array")
    out = []
    for item in data:
        value = item.get("claim") if isinstance(item, dict) else item
        if not isinstance(value, str) or not value.strip():
            raise AnswerError("a claim is not a text")
        out.append(value.strip())
    return out


def verdict(text: str) -> bool:
    data = _loaded(text)
    value = data.get("supported") if isinstance(data, dict) else None
    if not isinstance(value, bool):
        raise AnswerError("no boolean verdict")
    return value


def extracted(responses: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, at, type, title, content, summary, confidence, section_index, page, paragraph, reason)``.

    One row for each valid object, one with only a reason for each dropped element or unusable answer.
    """
    schema = (
        f"{key} string, at int, type string, title string, content string, summary string, confidence double, "
        "section_index bigint, page bigint, paragraph bigint, reason string"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                try:
                    kept, dropped = extraction(t or "")
                except AnswerError as error:
                    rows.append({key: k, "reason": str(error)})
                    continue
                rows += [{key: k, "at": i, **o} for i, o in enumerate(kept)]
                rows += [{key: k, "reason": r} for r in dropped]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("at", "section_index", "page", "paragraph"):
                frame[c] = frame[c].astype("Int64")
            for c in ("type", "title", "content", "summary", "reason"):
                frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
            frame["confidence"] = frame["confidence"].astype("float64")
            yield frame

    return responses.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, schema)


def retry_once(call: Callable[[], tuple[str, dict]], parse: Callable[[str], object]) -> tuple[object, list[dict]]:
    """Call and parse, once more if the answer cannot be parsed; both attempts are reported."""
    attempts = []
    for last in (False, True):
        text, usage = call()
        attempts.append(usage)
        try:
            return parse(text), attempts
        except AnswerError:
            if last:
                raise
    raise AssertionError


#: The shape of a whole JSON answer, fenced or not.
FENCED = re.compile(r"^```")
