"""Data keys by subject, wrapped under a root key and kept in files by the subject's hash.

Shredding a key deletes every file that held it; what was sealed with it stays unreadable for good.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import files


class Keyring(Protocol):
    """One with `issue(subjects)`, too, makes the keys of many subjects at once; else they are asked for one by one."""

    def get(self, subject: str) -> bytes | None: ...
    def put(self, subject: str, key: bytes) -> bytes: ...
    def delete(self, subject: str) -> bool: ...
    def frame(self) -> DataFrame: ...


def new_root_key(n: int = 32) -> bytes:
    """A root key of 16, 24 or 32 bytes."""
    if n not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    return os.urandom(n)


def root_key_from(environment: dict[str, str], name: str = "CHRONOFACT_ROOT_KEY") -> bytes | None:
    """The base64 root key of a setting; None if it is unset, in which case nothing is sealed or signed."""
    if not (text := environment.get(name)):
        return None
    key = base64.b64decode(text, validate=True)
    if len(key) not in (16, 24, 32):
        raise ValueError(f"{name} must be 16, 24 or 32 bytes in base64")
    return key


class Sealer:
    """AES-GCM on the driver in the layout of Spark's aes_encrypt: nonce, ciphertext, tag."""

    def __init__(self, spark, key: bytes):
        self.crypto, self.key = spark._jvm.javax.crypto, key

    def _cipher(self, mode: int, nonce: bytes):
        cipher = self.crypto.Cipher.getInstance("AES/GCM/NoPadding")
        cipher.init(mode, self.crypto.spec.SecretKeySpec(self.key, "AES"), self.crypto.spec.GCMParameterSpec(128, nonce))
        return cipher

    def seal(self, data: bytes) -> str:
        nonce = os.urandom(12)
        return base64.b64encode(nonce + bytes(self._cipher(1, nonce).doFinal(data))).decode()

    def open(self, text: str) -> bytes:
        """The data; an error if the key is another one or a byte was changed."""
        raw = base64.b64decode(text)
        return bytes(self._cipher(2, raw[:12]).doFinal(raw[12:]))


#: Keys lie in parts by so many first hex digits of their subject's hash: 16, as a file costs the driver some 0.1 s where it must start a process for its mode.
DIGITS = 1
#: Seconds that a replaced file is left for readers that began before.
LEFT = 3600
#: Files that are published at once.
THREADS = 8


@F.pandas_udf(BinaryType())
def _random_keys(subjects: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(32) for _ in range(len(subjects))])


class FileKeyring:
    """Wrapped keys in parts by subject hash; each change of a part is a whole new file of the next number.

    A number is published only if no other writer took it, so a subject has one key however
    many writers meet. `issue` makes the keys of any number of subjects where their rows
    are; the driver then publishes one file for each part. Deleting a key deletes every
    file that held it. A file for each subject, as earlier versions wrote, is read as well.
    """

    def __init__(self, spark, path: str, root_key: bytes):
        self.spark, self.path, self.root_key, self.sealer = spark, path, root_key, Sealer(spark, root_key)

    def _single(self, subject: str) -> str:
        """The file that an earlier version kept the subject's key in."""
        return f"{self.path}/{hashlib.sha256(subject.encode()).hexdigest()}.json"

    def _part_of(self, subject: str) -> str:
        return hashlib.sha256(subject.encode()).hexdigest()[:DIGITS]

    def _file(self, part: str, number: int) -> str:
        return f"{self.path}/{part}-{number:012d}.json"

    def _numbers(self, part: str = "*") -> dict[str, list[int]]:
        """The numbers of each part's files, rising."""
        found: dict[str, list[int]] = {}
        for n in files.names(self.spark, self.path, f"{part}-*.json"):
            own, number = n.removesuffix(".json").split("-")
            found.setdefault(own, []).append(int(number))
        return found

    def _rows(self, part: str, number: int) -> dict[str, str] | None:
        text = files.read(self.spark, self._file(part, number))
        return None if text is None else {r["subject_id"]: r["wrapped"] for r in map(json.loads, text.splitlines())}

    def _last(self, part: str) -> tuple[int, dict[str, str]]:
        """A part's last number, 0 if it has none, and its wrapped keys."""
        while True:
            number = self._numbers(part).get(part, [0])[-1]
            rows = self._rows(part, number) if number else {}
            if rows is not None:  # else it was replaced and deleted in between
                return number, rows

    def _counts(self, part: str, number: int) -> bool:
        """Whether a file just published is the part's last or went into the last one.

        Its number may have been taken before and deleted since, by writers that were
        quicker than two changes; then it counts for nothing and goes.
        """
        last, rows = self._last(part)
        if last == number or all(s in rows for s in self._rows(part, number) or {"": ""}):
            return True
        files.delete(self.spark, self._file(part, number))
        return False

    def _replace(self, part: str, number: int, rows: dict[str, str]) -> bool:
        text = "".join(json.dumps({"subject_id": s, "wrapped": w}) + "\n" for s, w in rows.items())
        return files.publish(self.spark, self._file(part, number), text) and self._counts(part, number)

    def _tidy(self, found: dict[str, list[int]]) -> None:
        """Delete files that were replaced long ago."""
        for part, numbers in found.items():
            for n, newer in zip(numbers, numbers[1:]):
                if files.age(self.spark, self._file(part, newer)) > LEFT:
                    files.delete(self.spark, self._file(part, n))

    def get(self, subject: str) -> bytes | None:
        wrapped = self._last(self._part_of(subject))[1].get(subject)
        if wrapped is None and (text := files.read(self.spark, self._single(subject))):
            wrapped = json.loads(text)["wrapped"]
        return self.sealer.open(wrapped) if wrapped else None

    def put(self, subject: str, key: bytes) -> bytes:
        """The subject's key: this one, or the one that another writer was quicker to put."""
        part = self._part_of(subject)
        while True:
            number, rows = self._last(part)
            if subject in rows or files.read(self.spark, self._single(subject)):
                return self.get(subject) or self.put(subject, key)
            if self._replace(part, number + 1, rows | {subject: self.sealer.seal(key)}):
                self._tidy(self._numbers(part))
                return key

    def key_for(self, subject: str) -> bytes:
        return self.get(subject) or self.put(subject, os.urandom(32))

    def issue(self, subjects: DataFrame) -> None:
        """A new key for each subject_id that has none. Tasks make and wrap them; the driver puts a part's new ones behind its old ones.

        Parts that another writer changed meanwhile are done again.
        """
        asked = subjects.select("subject_id").where("subject_id IS NOT NULL").distinct()
        part = F.substring(F.sha2("subject_id", 256), 1, DIGITS).alias("part")
        wrapped = F.base64(F.aes_encrypt(_random_keys.asNondeterministic()("subject_id"), F.lit(self.root_key), F.lit("GCM")))
        while True:
            before = self._numbers()
            new = asked.join(self._wrapped(before).select("subject_id"), "subject_id", "left_anti")
            draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
            try:
                new.select("subject_id", wrapped.alias("wrapped"), part).repartition("part").write.partitionBy("part").json(draft)

                def publish(folder: str) -> bool:
                    own = folder.removeprefix("part=")
                    last = before.get(own, [0])[-1]
                    old = [self._file(own, last)] if last else []
                    made = [f"{draft}/{folder}/{n}" for n in files.names(self.spark, f"{draft}/{folder}")]
                    return files.publish(self.spark, self._file(own, last + 1), "", [*old, *made]) and self._counts(own, last + 1)

                with ThreadPoolExecutor(THREADS) as pool:
                    done = list(pool.map(publish, files.names(self.spark, draft, "part=*")))
            finally:
                files.delete(self.spark, draft)
            if all(done):
                return self._tidy(self._numbers())

    def delete(self, subject: str) -> bool:
        """Whether there was a key. Files of its part but the last go, so that none holds it."""
        gone, part = files.delete(self.spark, self._single(subject)), self._part_of(subject)
        while True:
            number, rows = self._last(part)
            if subject not in rows:
                break
            if self._replace(part, number + 1, {s: w for s, w in rows.items() if s != subject}):
                gone = True
        for n in self._numbers(part).get(part, [])[:-1]:
            files.delete(self.spark, self._file(part, n))
        return gone

    def _wrapped(self, numbers: dict[str, list[int]]) -> DataFrame:
        """(subject_id, wrapped) of each part's last file, and of files of single subjects."""
        schema = "subject_id string, wrapped string"
        last = [f"{part}-{n[-1]:012d}.json" for part, n in numbers.items()]
        single = "?" * 64 + ".json"
        if files.names(self.spark, self.path, single):
            last.append(single)
        if not last:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", f"{{{','.join(last)}}}").json(self.path)

    def frame(self) -> DataFrame:
        """(subject_id, key) of all subjects that have one; keys are unwrapped where the rows are used."""
        return self._wrapped(self._numbers()).select("subject_id", F.aes_decrypt(F.unbase64("wrapped"), F.lit(self.root_key), F.lit("GCM")).alias("key"))
