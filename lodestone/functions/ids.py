"""Content-derived identities. All are lower-case hex SHA-256; parts are joined by a NUL character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_text(c) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def joined_id(*parts) -> Column:
    """SHA-256 of the parts with NULs between; null if any part is null."""
    cols = [_col(p).cast("string") for p in parts]
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, F.lit(NUL), c)
    return F.sha2(out.cast("binary"), 256)


def root_id(identity) -> Column:
    return sha256_text(identity)


def document_id(root, uri) -> Column:
    return joined_id(root, uri)


def chunk_id(document, recipe, ordinal, text) -> Column:
    return joined_id(document, recipe, ordinal, text)


def seeded_rank(seed: str, kind: str, id_col) -> Column:
    """A hash that orders ids by seed and kind; each part is preceded by its byte length as eight big-endian bytes."""

    def part(c: Column) -> Column:
        raw = c.cast("binary")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)

    return F.sha2(F.concat(part(F.lit(seed)), part(F.lit(kind)), part(_col(id_col).cast("string"))), 256)


def parity(id_col) -> Column:
    """The lowest bit of the first hash byte: 0 or 1."""
    return F.conv(F.substring(sha256_text(_col(id_col).cast("string")), 1, 2), 16, 10).cast("int") % 2
