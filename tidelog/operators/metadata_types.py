"""Rows of the control state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topic:
    name: str
    keyspace_size: int
    state: str = "active"
    next_range_seq: int = 0
    policy: str | None = None


@dataclass(frozen=True)
class Range:
    topic: str
    seq: int
    key_start: int
    key_end: int
    state: str = "active"
    parents: tuple[int, ...] = ()


@dataclass(frozen=True)
class Segment:
    ident: str
    topic: str
    range_seq: int
    replica_set: tuple[str, ...]
    start_offset: int
    state: str = "active"
    length: int | None = None
    byte_size: int | None = None
    sealed_at: int | None = None
