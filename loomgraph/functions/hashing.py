"""Content identities: node keys, passage keys, partition buckets and audit ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node key prefixes.
ENTITY_PREFIX = "entity-"
SENTENCE_PREFIX = "sentence-"
PASSAGE_PREFIX = "passage-"

# Multiplier, increment and modulus of the audit id.
AUDIT_MULTIPLIER = 1103515245
AUDIT_INCREMENT = 12345
AUDIT_MODULUS = 2147483647


def node_key(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def entity_key(text: Column) -> Column:
    return node_key(ENTITY_PREFIX, text)


def sentence_key(text: Column) -> Column:
    return node_key(SENTENCE_PREFIX, text)


def passage_key(text: Column) -> Column:
    return node_key(PASSAGE_PREFIX, text)


def key_bytes(hash_id: Column) -> Column:
    """The 16 bytes of a node key; half its length and in the same order within one prefix."""
    return F.unhex(F.substring_index(hash_id, "-", -1))


def key_text(prefix: Column, key: Column) -> Column:
    return F.concat(prefix, F.lower(F.hex(key)))


def packed_key(hash_id: Column) -> Column:
    """A node key as 17 bytes: the first letter of its prefix, then the bytes of its hash."""
    return F.concat(F.substring(hash_id, 1, 1).cast("binary"), key_bytes(hash_id))


def unpacked_key(packed: Column) -> Column:
    first = F.substring(F.hex(packed), 1, 2)
    prefix = F.when(first == "65", ENTITY_PREFIX).when(first == "73", SENTENCE_PREFIX).otherwise(PASSAGE_PREFIX)
    return F.concat(prefix, F.lower(F.substring(F.hex(packed), 3, 32)))


def title_id(title: Column) -> Column:
    """Passage id of a titled document."""
    return F.sha1(title)


def title_sentence_id(passage_id: Column, position: Column) -> Column:
    return F.sha1(F.concat_ws("::", passage_id, position.cast("string")))


def title_client(title: Column, num_clients: int) -> Column:
    """128-bit md5 modulo ``num_clients``, folded 32 bits at a time so every step fits a BIGINT."""
    if not 0 < num_clients < 2**31:
        raise ValueError("num_clients must be between 1 and 2^31 - 1")
    digest = F.md5(title)
    n = F.lit(num_clients).cast("bigint")
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(2**32) + word) % n
    return rest.cast("int")


def chunk_client(index: Column, num_clients: int) -> Column:
    """Chunks without an index (-1) go where index 0 goes."""
    return F.pmod(F.greatest(index, F.lit(0)), F.lit(num_clients)).cast("int")


def audit_id(node_id: Column) -> Column:
    """Linear congruence of the id; reduced first so that no id overflows a BIGINT."""
    modulus = F.lit(AUDIT_MODULUS).cast("bigint")
    return F.pmod(F.pmod(node_id.cast("bigint"), modulus) * F.lit(AUDIT_MULTIPLIER).cast("bigint") + F.lit(AUDIT_INCREMENT), modulus)
