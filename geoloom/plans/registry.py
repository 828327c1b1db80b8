"""The registered queries and the SQL that states what each must return."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: tuple[str, ...] = (), recursive: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``base`` are leading SQL table definitions."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            head = ("with recursive " if recursive else "with ") + ", ".join(base) if base else ""
            text = sql.strip()
            if base and text[:1] == ",":
                ORACLES[name] = f"{head} {text}"
            else:
                ORACLES[name] = f"{head} {text}".strip()
        return fn

    return register
