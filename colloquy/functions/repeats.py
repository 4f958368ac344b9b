"""Phrases said again at once, kept once: whole columns in Arrow batches, in time linear in a text."""

from __future__ import annotations

import re
from itertools import compress, count
from operator import eq

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD, SPACE = re.compile(r"\w+"), re.compile(r"\s+")


def _folded(text: str) -> str:
    """Lower case with every letter in its place: what would grow stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _one_round(text: str, most: int) -> str:
    """Each word is compared with those one to ``most`` places on; only places where a whole phrase agrees are looked at by letters."""
    low = _folded(text)
    words = WORD.findall(low)
    starts: dict[int, list[int]] = {}
    # a repetition may end within a word, so the phrase's last word is compared as a beginning
    for i in compress(count(), map(str.startswith, words[1:], words)):
        starts[i] = [1]
    for p in range(2, most + 1):
        before = -1
        run = 0
        for j in compress(count(), map(eq, words[p:], words)):
            run = run + 1 if j == before + 1 else 1
            before = j
            if run >= p - 1 and j + p + 1 < len(words) and words[j + p + 1].startswith(words[j + 1]):
                starts.setdefault(j - p + 2, []).append(p)
    if not starts:
        return text
    spans = [m.span() for m in WORD.finditer(low)]
    out, done = [], 0
    for i in sorted(starts):
        a = spans[i][0]
        if a < done:
            continue
        for p in reversed(starts[i]):
            b = end = spans[i + p - 1][1]
            if all(low[spans[k][1] : spans[k + 1][0]].isspace() for k in range(i, i + p - 1)):
                phrase = low[a:b]
                while (gap := SPACE.match(low, end)) and low.startswith(phrase, gap.end()):
                    end = gap.end() + len(phrase)
            if end > b:
                out.append(text[done:b])
                done = end
                break
    return "".join(out) + text[done:]


def _fixed(text: str, most: int = 6) -> str:
    while (shorter := _one_round(text, most)) != text:
        text = shorter
    return text


@F.pandas_udf(StringType())
def _texts(texts: pd.Series) -> pd.Series:
    return texts.map(_fixed, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda parts: [None if t is None else _fixed(t) for t in parts], na_action="ignore")


def collapsed(c: Column) -> Column:
    """Phrases of up to six words said again at once are kept once (letters' case aside), until nothing changes; null stays null."""
    return _texts(c)


def collapsed_each(c: Column) -> Column:
    """``collapsed`` for each text of an array."""
    return _lists(c)
