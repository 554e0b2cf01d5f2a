"""Files encrypted block by block: a 4-byte big-endian length, then the block's iv and ciphertext. Keys are the caller's."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

ROUNDS = 600_000


def derived_key(secret: bytes, salt: bytes, rounds: int = ROUNDS) -> bytes:
    """32 bytes, derived once on the driver."""
    return hashlib.pbkdf2_hmac("sha512", secret, salt, rounds, 32)


def written(blocks: Iterator[bytes], encrypt: Callable[[bytes], bytes]) -> bytes:
    out = bytearray()
    for b in blocks:
        c = encrypt(b)
        out += struct.pack(">I", len(c)) + c
    return bytes(out)


def read(data: bytes, decrypt: Callable[[bytes], bytes]) -> bytes:
    """A length that reaches past the data is an error."""
    out, at = bytearray(), 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("a block's length is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("a block is cut off")
        out += decrypt(data[at + 4 : at + 4 + n])
        at += 4 + n
    return bytes(out)
