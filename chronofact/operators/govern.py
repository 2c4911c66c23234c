"""Governed use of another store: record first, delete there, read back, keep a receipt."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Downstream(Protocol):
    def add(self, text: str, subject_id: str) -> Any: ...
    def delete(self, subject_id: str) -> Any: ...
    def read(self, subject_id: str) -> Any: ...


#: Keys under which stores list what they hold; the first present one decides.
LISTS = ("results", "memories", "data", "items")


def is_present(found: Any) -> bool:
    """Whether a read-back shows data; what is not understood counts as data."""
    if found is None:
        return False
    if isinstance(found, dict):
        for key in LISTS:
            if key in found:
                return bool(found[key])
        return bool(found)
    return bool(found) if isinstance(found, list | tuple | set) else True


@dataclass
class Receipt:
    subject_id: str
    deleted: bool
    verified: bool | None
    complete: bool
    error: str | None = None
    dry_run: bool = False


class Adapter:
    """A client's methods by name, or functions (client, ...), for add, search, delete and read.

    A name that the client lacks fails at once. Without `read` nothing is read back.
    """

    def __init__(self, client, add="add", search="search", delete="delete", read=None):
        self.client, self.calls = client, {}
        for what, how in (("add", add), ("search", search), ("delete", delete), ("read", read)):
            if how is None:
                continue
            if callable(how):
                self.calls[what] = lambda *a, __how=how: __how(client, *a)
            elif callable(found := getattr(client, how, None)):
                self.calls[what] = found
            else:
                raise AttributeError(f"{type(client).__name__} has no method {how!r} for {what}")

    @property
    def reads_back(self) -> bool:
        return "read" in self.calls

    def add(self, text: str, subject_id: str) -> Any:
        return self.calls["add"](text, subject_id)

    def search(self, query: str, subject_id: str | None = None) -> Any:
        return self.calls["search"](query, subject_id)

    def delete(self, subject_id: str) -> Any:
        return self.calls["delete"](subject_id)

    def read(self, subject_id: str) -> Any:
        return self.calls["read"](subject_id)


def adapter_for(client) -> Adapter:
    """An adapter by the methods that a client has: of each kind the first known name counts."""
    known = {"add": ("add", "insert", "store"), "search": ("search", "query", "find"), "delete": ("delete", "delete_all", "forget", "remove"), "read": ("read", "get_all", "get", "list")}
    chosen = {what: next((n for n in names if callable(getattr(client, n, None))), None) for what, names in known.items()}
    if missing := [w for w in ("add", "delete") if chosen[w] is None]:
        raise AttributeError(f"{type(client).__name__} has no method for {', '.join(missing)}")
    return Adapter(client, **chosen)


class Governed:
    """Writes go to the ledger, then to the store; a failed store write is raised after it was recorded."""

    def __init__(self, store: Downstream | Adapter, ledger, requested_by: str = "operator"):
        self.store, self.ledger, self.requested_by = store, ledger, requested_by

    def add(self, text: str, subject_id: str) -> Any:
        self.ledger.add(text, subject_id=subject_id)
        return self.store.add(text, subject_id)

    def search(self, query: str, subject_id: str | None = None) -> Any:
        """The store's own answer, passed through."""
        return self.store.search(query, subject_id)

    def forget(self, subject_id: str, dry_run: bool = False) -> tuple[Receipt, dict]:
        """Delete in the store, read back, record the outcome, erase in the ledger whatever the store did."""
        if dry_run:
            return Receipt(subject_id, False, None, False, dry_run=True), self.ledger.forget(subject_id, self.requested_by, dry_run=True)
        error, verified = None, None
        try:
            self.store.delete(subject_id)
        except Exception as e:  # the receipt tells what went wrong
            error = f"{type(e).__name__}: {e}"
        if getattr(self.store, "reads_back", hasattr(self.store, "read")):
            try:
                verified = not is_present(self.store.read(subject_id))
            except Exception as e:
                error = error or f"{type(e).__name__}: {e}"
        done = error is None
        self.ledger.record_outcome(subject_id, deleted=done, verified=verified)
        return Receipt(subject_id, done, verified, done and verified is not False, error), self.ledger.forget(subject_id, self.requested_by)


def from_environment(environment: dict[str, str], ledger) -> Governed | None:
    """A governed HTTP store if CHRONOFACT_UPSTREAM is set; an empty CHRONOFACT_UPSTREAM_READ turns read-back off."""
    if not (base := environment.get("CHRONOFACT_UPSTREAM")):
        return None
    from ..sources.http import HTTPClient

    paths = {w: environment[f"CHRONOFACT_UPSTREAM_{w.upper()}"] for w in ("add", "search", "delete", "read") if f"CHRONOFACT_UPSTREAM_{w.upper()}" in environment}
    client = HTTPClient(base, **paths)
    return Governed(Adapter(client, read="read" if client.paths["read"] else None), ledger)


def reconcile(tombstones: DataFrame, downstream: DataFrame) -> DataFrame:
    """Forgotten subjects and the rows that a store still has of them."""
    left = downstream.join(tombstones.select("subject_id").distinct(), "subject_id", "left_semi").groupBy("subject_id").agg(F.count("*").alias("rows_left"))
    return tombstones.select("subject_id").distinct().join(left, "subject_id", "left").select(
        "subject_id",
        F.coalesce("rows_left", F.lit(0)).alias("rows_left"),
        F.col("rows_left").isNull().alias("verified"),
    )
