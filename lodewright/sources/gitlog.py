"""Version-control history as tables: spark.read.format("git_history").option("repos", ...).option("table", ...).

Tables: commits, commit_files, blame_lines. repos lists repositories as id=path, separated by newlines; each is one
partition. The git program must be on the executors, and the repositories reachable under the same paths.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "project_id long, sha string, author_name string, author_email string, authored_at timestamp, committed_at timestamp, position int, message string",
    "commit_files": "project_id long, sha string, path string, added int, removed int",
    "blame_lines": "project_id long, path string, sha string, n_lines int",
}
_START, _FIELD = "\x01", "\x02"


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", errors="replace")


def checked_revision(revision: str) -> str:
    """A revision that git cannot take for an option."""
    if revision.startswith("-") or "\x00" in revision:
        raise ValueError(f"not a revision: {revision!r}")
    return revision


def _commits(repo: str, revision: str, limit: int) -> Iterator[tuple]:
    out = _git(repo, "log", f"-{limit}", f"--format={_START}%H{_FIELD}%an{_FIELD}%ae{_FIELD}%aI{_FIELD}%cI{_FIELD}%B", revision, "--")
    for position, entry in enumerate(out.split(_START)[1:]):
        sha, name, email, authored, committed, message = entry.split(_FIELD, 5)
        yield sha, name, email, datetime.fromisoformat(authored), datetime.fromisoformat(committed), position, message.rstrip("\n")


def _commit_files(repo: str, revision: str, limit: int) -> Iterator[tuple]:
    out = _git(repo, "log", f"-{limit}", "--numstat", "--no-renames", "-z", f"--format={_START}%H", revision, "--")
    for entry in out.split(_START)[1:]:
        sha, _, rest = entry.partition("\x00")
        for line in rest.split("\x00"):
            added, tab, more = line.strip("\n").partition("\t")
            removed, _, path = more.partition("\t")
            if tab and path:
                yield sha.strip(), path, None if added == "-" else int(added), None if removed == "-" else int(removed)


def _blame(repo: str, revision: str) -> Iterator[tuple]:
    for path in _git(repo, "ls-tree", "-r", "-z", "--name-only", revision).split("\x00"):
        if not path:
            continue
        try:
            out = _git(repo, "blame", "--porcelain", revision, "--", path)
        except subprocess.CalledProcessError:
            continue  # not a text file of that revision: no row rather than a guess
        runs: dict[str, int] = {}
        for line in out.split("\n"):
            head = line.split(" ")
            if len(head) == 4 and len(head[0]) == 40 and head[3].isdigit():
                runs[head[0]] = runs.get(head[0], 0) + int(head[3])
        yield from ((path, sha, n) for sha, n in runs.items())


class _Repo(InputPartition):
    def __init__(self, project_id: int, path: str):
        self.project_id, self.path = project_id, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.revision, self.limit = options.get("table", "commits"), checked_revision(options.get("revision", "HEAD")), int(options.get("limit", "10000"))
        pairs = [line.split("=", 1) for line in options.get("repos", "").splitlines() if line.strip()]
        self.repos = [_Repo(int(i), p) for i, p in pairs]

    def partitions(self) -> list[InputPartition]:
        return self.repos

    def read(self, partition: _Repo) -> Iterator[tuple]:
        rows = {"commits": lambda: _commits(partition.path, self.revision, self.limit), "commit_files": lambda: _commit_files(partition.path, self.revision, self.limit), "blame_lines": lambda: _blame(partition.path, self.revision)}
        for row in rows[self.table]():
            yield (partition.project_id, *row)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitHistory)
