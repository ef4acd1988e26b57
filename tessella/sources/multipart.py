"""Stores that take a file as numbered parts, and the session that writes one.

A part may be sent again (a task that is run again, or runs twice): the last one sent counts, so parts
survive the loss of executors.  Nothing can be seen at the target before the session is complete.
"""

from __future__ import annotations

import importlib
import os
import uuid
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import urlparse

from ..operators.layout import MAX_PARTS

#: Seconds for which a signed address holds, if nothing else is said.
SIGNED_SECONDS = 8 * 60 * 60
#: The client of addresses that name no other.
OWN_CLIENT = f"{__package__}.s3:client"


class Store(Protocol):
    def create(self) -> str: ...

    def upload(self, session: str, number: int, offset: int, data: bytes) -> str: ...

    def complete(self, session: str, parts: list[dict[str, Any]]) -> Any: ...

    def abort(self, session: str) -> None: ...


@dataclass(frozen=True)
class LocalStore:
    """A file on a disk that all tasks share.  Parts go to their places in a hidden file beside the
    target, which takes the target's name at the end."""

    path: str

    def _staged(self, session: str) -> str:
        folder, name = os.path.split(os.path.abspath(self.path))
        return os.path.join(folder, f".{name}.{session}")

    def create(self) -> str:
        session = uuid.uuid4().hex
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self._staged(session), "wb"):
            return session

    def upload(self, session: str, number: int, offset: int, data: bytes) -> str:
        with open(self._staged(session), "r+b") as f:
            f.seek(offset)
            f.write(data)
        return f"{number}-{len(data)}"

    def complete(self, session: str, parts: list[dict[str, Any]]) -> str:
        size = sum(int(p["ETag"].rpartition("-")[2]) for p in parts)
        if os.path.getsize(self._staged(session)) != size:
            raise OSError(f"{self.path}: parts have {size} bytes, the file {os.path.getsize(self._staged(session))}")
        os.replace(self._staged(session), self.path)
        return self.path

    def abort(self, session: str) -> None:
        if os.path.exists(self._staged(session)):
            os.unlink(self._staged(session))


@dataclass(frozen=True)
class S3Store:
    """An object behind a client with the calls of S3's multipart uploads.

    client: "module:function", called in each process with ``options``; no client travels between
    processes.
    """

    bucket: str
    key: str
    client: str
    options: dict[str, Any] = field(default_factory=dict)

    def _client(self) -> Any:
        module, _, name = self.client.partition(":")
        return getattr(importlib.import_module(module), name)(**{k: v for k, v in self.options.items() if k != "mpu_options"})

    def create(self) -> str:
        return self._client().create_multipart_upload(Bucket=self.bucket, Key=self.key, **self.options.get("mpu_options", {}))["UploadId"]

    def upload(self, session: str, number: int, offset: int, data: bytes) -> str:
        return self._client().upload_part(Bucket=self.bucket, Key=self.key, UploadId=session, PartNumber=number, Body=data)["ETag"]

    def complete(self, session: str, parts: list[dict[str, Any]]) -> Any:
        return self._client().complete_multipart_upload(Bucket=self.bucket, Key=self.key, UploadId=session, MultipartUpload={"Parts": parts})

    def abort(self, session: str) -> None:
        self._client().abort_multipart_upload(Bucket=self.bucket, Key=self.key, UploadId=session)


def resolved(path: str | Store, storage_options: dict[str, Any] | None = None) -> Store:
    """The store of an address: a local path, file://, or s3://.  Options of s3: client ("module:function"; the own one
    by default) and what the client is called with."""
    if not isinstance(path, str):
        return path
    options = dict(storage_options or {})
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return LocalStore(url.path if url.scheme else path)
    if url.scheme == "s3":
        store = S3Store(url.netloc, url.path.lstrip("/"), options.pop("client", None) or OWN_CLIENT, options)
        if store.client == OWN_CLIENT:
            store._client().checked()  # keys that are not there are missed here, not in a task
        return store
    raise ValueError(f"no store for {url.scheme}://")


def presigned_url(path: str | Store, expiration: int = SIGNED_SECONDS, storage_options: dict[str, Any] | None = None) -> str:
    """An address that anyone can read an object by for so many seconds."""
    store = resolved(path, storage_options)
    if not isinstance(store, S3Store):
        raise ValueError("only objects in S3 have signed addresses")
    return store._client().generate_presigned_url("get_object", Params={"Bucket": store.bucket, "Key": store.key}, ExpiresIn=expiration)


class MultipartSession:
    """One upload, from a process that has the parts at hand.  Without a store every call does nothing."""

    def __init__(self, store: str | Store | None, storage_options: dict[str, Any] | None = None) -> None:
        self.store = None if store is None else resolved(store, storage_options)
        self.id = None if self.store is None else self.store.create()
        self.done = self.store is None
        self.sent = 0

    def upload(self, number: int | None, data: Any, offset: int | None = None) -> dict[str, Any] | None:
        """Sends a part (bytes, or nested iterables of bytes); None for no number or no data."""
        if self.done or number is None or data is None:
            return None
        body = joined(data)
        if not body:
            return None
        if not 1 <= number <= MAX_PARTS:
            raise ValueError(f"part {number} of at most {MAX_PARTS}")
        place = self.sent if offset is None else offset
        receipt = {"PartNumber": number, "ETag": self.store.upload(self.id, number, place, body)}
        self.sent = place + len(body)
        return receipt

    def complete(self, receipts: Any) -> Any:
        """Makes the file of its parts, in the order of their numbers.  A failure ends the upload and is raised."""
        if self.done:
            return None
        self.done = True
        parts = sorted((r for r in flat(receipts) if r is not None), key=lambda r: r["PartNumber"])
        try:
            return self.store.complete(self.id, parts)
        except Exception:
            self.store.abort(self.id)
            raise

    def abort(self) -> None:
        if not self.done:
            self.done = True
            self.store.abort(self.id)


def flat(nested: Any) -> Any:
    """The dictionaries (and Nones) of nested lists."""
    if nested is None or isinstance(nested, dict):
        yield nested
    else:
        for x in nested:
            yield from flat(x)


def joined(nested: Any) -> bytes:
    """The bytes of nested iterables of bytes."""
    if isinstance(nested, (bytes, bytearray, memoryview)):
        return bytes(nested)
    if isinstance(nested, str):
        return nested.encode()
    return b"".join(joined(x) for x in nested)
