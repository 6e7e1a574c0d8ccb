"""Identifiers and signatures as expressions: name-based UUIDs and keyed hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of chunk ids, a parameter of every function here.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "lodestone.local")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def chunk_id(repo: Column, path: Column, index: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The id of a file's chunk; ``index`` counts the chunks that are not blank, from 0."""
    return uuid5(F.concat(repo, F.lit(":"), path, F.lit("#"), index.cast("string")), namespace)


def point_id(given: Column) -> Column:
    """An id as it is if it is a UUID, else the UUID of its name in the DNS namespace."""
    bare = F.regexp_replace(F.lower(given), r"^urn:uuid:|[{}-]", "")
    shaped = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike(r"^[0-9a-f]{32}\z"), shaped).otherwise(uuid5(given, uuid.NAMESPACE_DNS))


def hmac_sha256(secret: str, message: Column) -> Column:
    """The hex HMAC-SHA256 of a message, bytes or text in UTF-8; the key's pads are made on the driver, so the key is in no row."""
    import hashlib

    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def signature_valid(secret: str, message: Column, header: Column) -> Column:
    """Whether a signature header, with or without ``algorithm=``, is the message's HMAC. A missing header is invalid."""
    given = F.regexp_replace(header, r"^[^=]*=", "")
    return F.coalesce(hmac_sha256(secret, message) == given, F.lit(False))


def delivery_valid(secret: str | None, body: Column, headers: Column) -> Column:
    """Whether a webhook's delivery is authentic: by the signature of its raw body, or by a token.

    ``headers``: a map with lower-case names. The first of a GitHub signature, a GitLab token and a Gitea signature that is there
    decides; a delivery with none of them is not authentic. Without a secret every delivery is.
    """
    if not secret or not secret.strip():
        return F.lit(True)
    of = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(headers, F.lit(n)), F.lit("")) for n in names))
    signed = hmac_sha256(secret, body)
    hub, token, gitea = of("x-hub-signature-256", "x-hub-signature"), of("x-gitlab-token"), of("x-gitea-signature", "x-gitea-signature-256")
    plain = lambda c, names: F.trim(F.regexp_replace(F.trim(c), rf"^(?:{names})=", ""))
    same = F.when(hub.isNotNull(), plain(hub, "sha256|sha1") == signed).when(token.isNotNull(), F.trim(token) == secret.strip()).when(gitea.isNotNull(), plain(gitea, "sha256") == signed)
    return F.coalesce(same, F.lit(False))
