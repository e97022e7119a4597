"""Small hashes of the control plane; metadata-sized, so plain Python."""

from __future__ import annotations

import uuid

_MASK = (1 << 64) - 1


def fnv1a64(data: bytes, basis: int = 0xCBF29CE484222325) -> int:
    for b in data:
        basis = ((basis ^ b) * 0x100000001B3) & _MASK
    return basis


def coordinator(key: str, brokers: list[int]) -> int:
    """Broker that coordinates a group: FNV-1a of the key modulo the sorted brokers."""
    return sorted(brokers)[fnv1a64(key.encode()) % len(brokers)]


def topic_uuid(topic: str) -> uuid.UUID:
    """Stable id of a topic: two FNV hashes with different starts, version 8, standard variant."""
    both = fnv1a64(topic.encode()) << 64 | fnv1a64(topic.encode(), 0x9E3779B97F4A7C15)
    both = both & ~(0xF << 76) & ~(0x3 << 62) | 0x8 << 76 | 0x2 << 62
    return uuid.UUID(int=both)


def _crc32c_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
    return n


_CRC32C = [_crc32c_step(n) for n in range(256)]


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC32C[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF
