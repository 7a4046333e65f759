"""What differs between SQL dialects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from stratalith.errors import ConfigError


@dataclass(frozen=True)
class Dialect:
    """Marker ``$`` counts from 1, ``@p`` from 0, ``?`` not at all; lists bind as one array or one marker each."""

    id: str
    label: str
    advice: str
    quote: str = '"'
    marker: str = "?"
    array_lists: bool = False
    backslash: bool = False
    banned: tuple[str, ...] = ()
    check: Callable[[str], None] | None = None

    def mark(self, ordinal: int) -> str:
        """Marker of the ordinal-th driver parameter, counted from 0."""
        return {"$": f"${ordinal + 1}", "@p": f"@p{ordinal}", "?": "?"}[self.marker]


# Words that a dialect forbids beyond the common ones.
_ALL = (
    Dialect("postgres", "PostgreSQL", "ILIKE matches without case; ``value::type`` casts; ``||`` joins text.", marker="$", array_lists=True),
    Dialect("cockroachdb", "CockroachDB", "As PostgreSQL.", marker="$", array_lists=True),
    Dialect("mysql", "MySQL", "Backticks quote names; CONCAT joins text; ``||`` is a logical or.", quote="`", backslash=True),
    Dialect("mariadb", "MariaDB", "As MySQL.", quote="`", backslash=True),
    Dialect("sqlite", "SQLite", "Few date functions: date(), datetime(), strftime(); ``||`` joins text.", banned=("attach", "detach", "pragma", "reindex")),
    Dialect("sqlserver", "SQL Server", "TOP (n) or OFFSET/FETCH limit rows; ``+`` or CONCAT joins text.", marker="@p", banned=("exec", "execute", "merge", "openrowset", "openquery")),
    Dialect("spark", "Spark SQL", "Backticks quote names; ANSI mode; date_trunc, try_cast and higher-order functions are there.", quote="`", backslash=True, banned=("cache", "refresh", "reflect", "java_method", "transform using")),
)
DIALECTS = {d.id: d for d in _ALL}


def dialect(name: str) -> Dialect:
    """Dialect by id; an error names those there are."""
    if name not in DIALECTS:
        raise ConfigError(f"no dialect {name!r}; there are {', '.join(DIALECTS)}", "UNKNOWN_DIALECT")
    return DIALECTS[name]
