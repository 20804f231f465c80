"""Masking of identifiers by keyed digests.

The built-in form takes its key as a literal and is for public test keys only: a literal shows in plans and event logs.
With a secret key use :func:`masker`, whose key is read from the environment in the worker.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Kinds and patterns of what is masked before a span leaves, in this order.
LINKEDIN = r"https?://(?:www\.)?linkedin\.com/[^\s]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\w)\+?\d[\d\s().-]{7,}\d(?!\w)"

PATTERNS = (("linkedin", re.compile(LINKEDIN, re.IGNORECASE)), ("email", re.compile(EMAIL)), ("phone", re.compile(PHONE)))


def digest16(value: str, key: bytes) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:16]


def mask_text(text: str, key: bytes) -> str:
    for kind, pattern in PATTERNS:
        text = pattern.sub(lambda m, kind=kind: f"<{kind}:{digest16(m.group(), key)}>", text)
    return text


def masker(key_env: str):
    """A vectorised function of texts; a missing key fails the task, so that nothing leaves unmasked."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        key = os.environ.get(key_env)
        if not key:
            raise RuntimeError(f"the key variable {key_env} is not set")
        return texts.map(lambda t: None if t is None else mask_text(t, key.encode()))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac16(value: Column, public_key: str) -> Column:
    """The first 16 hex digits of HMAC-SHA-256, in built-in functions."""
    inner, outer = _pads(public_key)
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256))), 256), 1, 16)


def mask_emails(text: Column, public_key: str) -> Column:
    """Replaces e-mail addresses by their digests, without Python."""
    def build(hits: Column) -> Column:
        marks = F.transform(hits, lambda h: F.concat(F.lit("<email:"), hmac16(h, public_key), F.lit(">")))
        gaps = F.split(text, EMAIL, -1)
        return F.when(F.size(hits) == 0, text).otherwise(F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), marks.alias("m")), lambda z: F.concat(z["g"], F.coalesce(z["m"], F.lit("")))), ""))

    return let(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), build)
