"""JSON objects in the output of language models."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


_SPLIT = ("Expecting ',' delimiter", "Expecting ':' delimiter", "Expecting property name enclosed in double quotes", "Expecting value", "Illegal trailing comma")
"""How a parser complains of the text after a quote that ended a string too early."""


def repaired(body: str) -> dict:
    """The object in body; where the parser stumbles over text that follows a string's end, the quote that seemed to end the
    string is part of it and is escaped. Each step escapes one more quote, so there are at most as many as quotes."""
    for _ in range(body.count('"') + 1):
        try:
            return json.loads(body)
        except json.JSONDecodeError as e:
            quote = body.rfind('"', 0, e.pos)
            if quote <= 0 or body[quote - 1] == "\\" or not e.msg.startswith(_SPLIT):
                raise
            body = f'{body[:quote]}\\"{body[quote + 1 :]}'
    raise ValueError("no JSON object after all repairs")


def extract_json(text: str, repair: bool = False) -> dict:
    """The object in a model's answer: its thoughts and whatever surrounds the outermost braces are left out."""
    answer = re.search(r"\{.*\}", text.rpartition("</think>")[2], re.S)
    if answer is None:
        raise ValueError(f"an answer without a JSON object: {text.strip()[:200]!r}")
    return (repaired if repair else json.loads)(answer[0])


@F.pandas_udf(StringType())
def json_object(s: pd.Series) -> pd.Series:
    """The object in each text as JSON, repaired if need be; null where there is none. Read it with from_json."""

    def of(text):
        try:
            return json.dumps(extract_json(text or "", repair=True), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(of)
