"""Keyed, deterministic choices as native expressions: picks from lists, date jitter, accession hashes.

Keys appear in query plans as binary literals; keep plans and their logs as private as the keys.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 32
MIN_JITTER, MAX_JITTER = 3, 180
#: Fixed value: it separates this use of the key from others.
JITTER_CONTEXT = b"date_jitter_v1:"


class Keys:
    """Salt and key of 32 bytes each."""

    def __init__(self, salt: bytes, key: bytes):
        if len(salt) != KEY_BYTES or len(key) != KEY_BYTES:
            raise ValueError(f"salt and key have {KEY_BYTES} bytes each")
        self.salt, self.key = salt, key

    def __repr__(self) -> str:
        return "Keys(...)"

    @classmethod
    def generate(cls) -> "Keys":
        return cls(secrets.token_bytes(KEY_BYTES), secrets.token_bytes(KEY_BYTES))

    @classmethod
    def derive(cls, phrase: str) -> "Keys":
        """Of a passphrase, for reproducible runs."""
        return cls(hashlib.sha256(b"salt:" + phrase.encode()).digest(), hashlib.sha256(b"key:" + phrase.encode()).digest())

    @classmethod
    def from_hex(cls, salt: str, key: str) -> "Keys":
        return cls(bytes.fromhex(salt.strip()), bytes.fromhex(key.strip()))

    @classmethod
    def load(cls, salt_path: str, key_path: str) -> "Keys":
        return cls.from_hex(Path(salt_path).read_text(), Path(key_path).read_text())

    def save(self, salt_path: str, key_path: str) -> None:
        for path, value in ((salt_path, self.salt), (key_path, self.key)):
            Path(path).touch(mode=0o600)
            Path(path).write_text(value.hex())

    @property
    def both(self) -> bytes:
        return self.salt + self.key


def _binary(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def keyed_index(text: Column, keys: Keys, n: int) -> Column:
    """0 to n - 1: the first 8 bytes, big-endian, of SHA-256(salt, key, text) modulo n."""
    digest = F.sha2(F.concat(_binary(keys.both), F.encode(text, "UTF-8")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("int")


def keyed_pick(text: Column, keys: Keys, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), keyed_index(text, keys, len(values)) + 1)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 by two nested hashes; the key is at most one block."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(_binary(bytes(b ^ 0x36 for b in block)), message), 256))
    return F.sha2(F.concat(_binary(bytes(b ^ 0x5C for b in block)), inner), 256)


def patient_jitter(patient: Column, keys: Keys, least: int = MIN_JITTER, most: int = MAX_JITTER) -> Column:
    """Days to shift a patient's dates: least to most, either way; null without a patient."""
    if least < MIN_JITTER or most < least:
        raise ValueError(f"jitter must be {MIN_JITTER} days or more, and the most not under the least")
    digest = hmac_sha256(F.concat(_binary(JITTER_CONTEXT), F.encode(patient, "UTF-8")), keys.both)
    days = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (most - least + 1) + least).cast("int")
    return F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, days).otherwise(-days)


def jitter_or_default(jitter: Column, patient: Column, keys: Keys, required: bool = False) -> Column:
    """The given jitter, else the patient's. Without either: an error if required, else that of an empty name."""
    if required:
        return F.coalesce(jitter.cast("int"), F.raise_error(F.lit("jitter is missing")).cast("int"))
    return F.coalesce(jitter.cast("int"), patient_jitter(F.coalesce(patient, F.lit("")), keys))


def valid_jitter(jitter: Column) -> Column:
    return jitter.isNotNull() & (F.abs(jitter) >= MIN_JITTER)


def accession_hash(value: Column, salt: Column | None = None, study: Column | None = None, entity: Column | None = None) -> Column:
    """The first 16 digits of upper hex SHA-256 of salt|study|entity|value, each trimmed and in upper case. A missing
    part is [S], [U] or [E]; an empty one stays empty."""
    part = lambda c, default: F.lit(default) if c is None else F.coalesce(F.upper(F.trim(c)), F.lit(default))
    joined = F.concat_ws("|", part(salt, "[S]"), part(study, "[U]"), part(entity, "[E]"), F.upper(F.trim(F.coalesce(value, F.lit("")))))
    return F.substring(F.upper(F.sha2(joined, 256)), 1, 16)
