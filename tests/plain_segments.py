"""Segmenting one job as a plain walk over its words: what the distributed steps must agree with."""

from __future__ import annotations

import re
from bisect import bisect_left
from math import ceil, floor

import pandas as pd

from cuebeam.functions.text import CONNECTORS, REFERS_BACK
from cuebeam.operators.segments import SegmentOptions, enforce_floors_rows


def place_cuts(raw: list[str], norm: list[str], at: list[int], reach: int = 5) -> list[int]:
    """A cut for each mention, in order: at the clause that holds it, after the cut before."""
    cuts: list[int] = []
    free = 0
    for m in at:
        cut = m
        for i in range(m - 1, max(free, m - reach) - 1, -1):
            if raw[i][-1:] in tuple(",;:—–-") and raw[i]:
                cut = i + 1
                break
            if norm[i] in CONNECTORS:
                cut = i
                break
        cuts.append(max(free, cut))
        free = cuts[-1] + 1
    return cuts


def _round(x: float) -> int:
    return floor(x + 0.5)


class _Words:
    def __init__(self, w: pd.DataFrame):
        self.raw, self.norm, self.start, self.end = (w[c].tolist() for c in ("raw", "norm", "start_ms", "end_ms"))

    def segment(self, a: int, b: int, entity, source, confidence, trigger) -> dict:
        return {"start_ms": self.start[a], "end_ms": self.end[b - 1], "entity_id": entity, "source": source, "confidence": confidence, "text": " ".join(self.raw[a:b]), "from_word": a, "to_word": b, "trigger_surface": trigger}


def _hold_end(w: _Words, a: int, b: int, said_until: int, options: SegmentOptions) -> int:
    """Where in words [a, b) the narration stops referring to who was named."""
    if not options.carry_forward:
        return a + 1
    ends = re.compile("[.!?][\"')\\]]?$")
    initial = re.compile("^[A-Za-z]\\.$")
    starts = [i for i in range(a + 1, b) if ends.search(w.raw[i - 1]) and not initial.search(w.raw[i - 1])]
    for s, e in zip(starts, [*starts[1:], b], strict=False):
        text = " ".join(w.raw[s:e])
        if w.start[s] - said_until > options.carry_forward_ms or not any(re.search(p, text) for p in REFERS_BACK):
            return s
    return b


def _split_on_onsets(w: _Words, seg: dict, most: int) -> list[dict]:
    length, a, b = seg["end_ms"] - seg["start_ms"], seg["from_word"], seg["to_word"]
    if length <= most or b - a < 4:
        return [seg]
    parts, out = ceil(length / most), []
    for p in range(parts):
        if a >= b:
            break
        to = b
        if p < parts - 1:
            target = seg["start_ms"] + length / parts * (p + 1)
            lo = min(a + 1, b)
            k = bisect_left(w.start, target, lo, b)
            near = [x for x in (k - 1, k) if lo <= x < b]
            to = min(near, key=lambda x: (abs(w.start[x] - target), x)) if near else lo
            to = bisect_left(w.start, w.start[to], lo, b) if near else to  # the first of equal onsets
        out.append(w.segment(a, max(a + 1, min(to, b)), seg["entity_id"], seg["source"], seg["confidence"], seg["trigger_surface"] if p == 0 else None))
        a = out[-1]["to_word"]
    return out


def segment_job(words: pd.DataFrame, mentions: pd.DataFrame, total: int, options: SegmentOptions) -> list[dict]:
    """All steps for one job; words and mentions in order."""
    whole = {"start_ms": 0, "end_ms": total, "entity_id": None, "source": "broll", "confidence": 0.0, "text": "", "from_word": 0, "to_word": 0, "trigger_surface": None}
    if not len(words):
        return [whole | {"seg_index": 0, "duration_ms": total}] if total > 0 else []
    w, n = _Words(words), len(words)
    changes = [m for m, b in zip(mentions.itertuples(), [None, *mentions["entity_id"]], strict=False) if m.entity_id != b]
    rows: list[dict] = []
    if not changes:
        rows.append(w.segment(0, n, None, "broll", 0.0, None))
    else:
        cuts = place_cuts(w.raw, w.norm, [int(m.word_index) for m in changes])
        if cuts[0] > 0:
            rows.append(w.segment(0, cuts[0], None, "broll", 0.0, None))
        for m, a, b in zip(changes, cuts, [*cuts[1:], n], strict=True):
            if b <= a:
                continue
            hold = _hold_end(w, a, b, int(m.end_ms), options)
            rows.append(w.segment(a, hold, m.entity_id, "named", float(m.confidence), m.surface))
            if hold < b:
                rows.append(w.segment(hold, b, None, "broll", 0.0, None))
    merged: list[dict] = []
    for r in rows:
        if merged and merged[-1]["entity_id"] == r["entity_id"] and merged[-1]["to_word"] == r["from_word"]:
            merged[-1] |= {"end_ms": r["end_ms"], "to_word": r["to_word"], "text": f"{merged[-1]['text']} {r['text']}".strip()}
        else:
            merged.append(r)
    rows = enforce_floors_rows(merged, options.min_named_ms, options.min_broll_ms)
    rows = [p for r in rows for p in _split_on_onsets(w, r, options.max_duration_ms)]
    rows.sort(key=lambda r: r["start_ms"])
    rows[0]["start_ms"] = 0
    for a, b in zip(rows, rows[1:], strict=False):
        a["end_ms"] = b["start_ms"]
    rows[-1]["end_ms"] = max(total if total > 0 else rows[-1]["end_ms"], rows[-1]["start_ms"] + 1)
    out: list[dict] = []
    for r in rows:
        length = r["end_ms"] - r["start_ms"]
        parts = ceil(length / options.max_duration_ms) if length > options.max_duration_ms * 1.25 else 1
        for p in range(parts):
            end = r["end_ms"] if p == parts - 1 else r["start_ms"] + _round(length * (p + 1) / parts)
            out.append(r | {"start_ms": r["start_ms"] + _round(length * p / parts), "end_ms": end} | ({"text": "", "trigger_surface": None} if p else {}))
    return [r | {"seg_index": k, "duration_ms": r["end_ms"] - r["start_ms"]} for k, r in enumerate(out) if r["end_ms"] > r["start_ms"]]
