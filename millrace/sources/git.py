"""Git repositories as a Python data source: one partition per repository, run by the git command."""

from __future__ import annotations

import json
import re
import subprocess
import tempfile
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.text import glob_regex
from millrace.functions.urls import with_token

# How each provider lists the repositories of an organisation (URL, header of the token, field of the clone URL).
PROVIDERS = {
    "github": ("https://api.github.com", "{base}/orgs/{org}/repos?per_page=100&page={page}", ("Authorization", "Bearer {token}"), "clone_url"),
    "gitlab": ("https://gitlab.com", "{base}/api/v4/groups/{org}/projects?per_page=100&page={page}", ("PRIVATE-TOKEN", "{token}"), "http_url_to_repo"),
    "gitea": ("", "{base}/api/v1/orgs/{org}/repos?limit=50&page={page}", ("Authorization", "token {token}"), "clone_url"),
}
SCHEMA = "repo string, head string, operation string, path string, old_path string, committed_at timestamp, size long, content binary"


def list_repositories(provider: str, org: str, token: str = "", base_url: str = "", fetch=None) -> list[str]:
    """Clone URLs of an organisation, all pages, in order. `fetch(url, headers)` returns the decoded JSON of a page."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown git provider {provider!r}; one of {', '.join(sorted(PROVIDERS))}")
    default, url, (header, value), field = PROVIDERS[provider]
    headers = {header: value.format(token=token)} if token else {}

    def over_http(address: str, headers: dict) -> object:
        with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=30) as r:
            return json.load(r)

    out: dict[str, None] = {}
    for page in count(1):
        got = (fetch or over_http)(url.format(base=(base_url or default).rstrip("/"), org=org, page=page), headers)
        fresh = [r[field] for r in got if field in r and r[field] not in out] if isinstance(got, list) else []
        if not fresh:
            break
        out.update(dict.fromkeys(fresh))
    return list(out)


def git(folder: Path | str, *args: str) -> str:
    done = subprocess.run(["git", "-C", str(folder), "-c", "core.quotePath=false", *args], capture_output=True, text=True, errors="surrogateescape", timeout=600, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.strip()[:500]}")
    return done.stdout


def _names(text: str) -> list[str]:
    """The parts of an output that ends each with a zero byte, so that names of any signs come as they are."""
    return [x for x in text.split("\0") if x]


def _ended(stream) -> Iterator[str]:
    """As _names(), of a stream, bit by bit."""
    held = b""
    while piece := stream.read(1 << 16):
        *whole, held = (held + piece).split(b"\0")
        yield from (x.decode(errors="surrogateescape") for x in whole if x)
    if held:
        yield held.decode(errors="surrogateescape")


def _diff(folder: str, since: str, head: str) -> list[tuple[str | None, str, str | None]]:
    """operation, path and old path of what changed between two commits."""
    parts, out = iter(_names(git(folder, "diff", "-z", "--name-status", "-M", since, head))), []
    for mark in parts:
        old = next(parts) if mark[:1] in "RC" else None
        out.append(({"A": "add", "C": "add", "M": "modify", "T": "modify", "D": "delete", "R": "rename"}.get(mark[:1]), next(parts), old if mark[:1] == "R" else None))
    return out


def last_commits(folder: str, head: str, paths: set[str]) -> dict[str, str]:
    """The time of the last commit of each path, from one pass over the history, which ends when all are known."""
    out: dict[str, str] = {}
    stamp, waiting = "", set(paths)
    run = subprocess.Popen(["git", "-C", folder, "log", "-z", "--format=%x01%cI", "--name-only", "--no-renames", head], stdout=subprocess.PIPE)
    for name in _ended(run.stdout):
        if not waiting:
            break
        if name.startswith("\x01"):
            stamp = name[1:]
        elif (name := name.removeprefix("\n")) in waiting:  # a line ends before the first name of a commit
            out[name] = stamp
            waiting.discard(name)
    run.stdout.close()
    run.terminate()
    run.wait()
    return out


@dataclass
class Repository(InputPartition):
    url: str
    since: str | None


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.since = json.loads(options.get("since", "{}"))
        self.branch, self.token = options.get("branch", ""), options.get("token", "")
        self.max_bytes = int(options.get("maxBytes", 25 << 20))
        self.include, self.exclude = (json.loads(options.get(k, "[]")) for k in ("include", "exclude"))

    def selected(self, path: str) -> bool:
        """As the folder source selects: a pattern may match the whole path or its last part; exclusion first, and no inclusion pattern includes everything."""
        hit = lambda patterns: any(re.search(glob_regex(p).replace(r"\z", r"\Z"), x) for p in patterns for x in (path, path.rpartition("/")[2]))
        return not hit(self.exclude) and (not self.include or hit(self.include))

    @staticmethod
    def has(folder: str, commit: str) -> bool:
        try:
            git(folder, "cat-file", "-e", f"{commit}^{{commit}}")
        except RuntimeError:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [Repository(r, self.since.get(r)) for r in dict.fromkeys(self.repos)]

    def read(self, partition: Repository) -> Iterator[tuple]:
        """Clone, compare with the head seen before, and yield what changed; without one, everything is an addition.

        After a head that is gone (its branch was forced elsewhere) a row `reset` comes first, then everything as additions:
        what was known of the repository is void. A file that is too large, or no file, now counts as deleted."""
        from datetime import datetime

        name = partition.url.rstrip("/").rpartition("/")[2].removesuffix(".git")
        with tempfile.TemporaryDirectory() as folder:
            git(".", "clone", "--quiet", *(["--branch", self.branch] if self.branch else []), with_token(partition.url, self.token), folder)
            head = git(folder, "rev-parse", "HEAD").strip()
            if head == partition.since:
                return
            known = partition.since and self.has(folder, partition.since)
            if known:
                changes = _diff(folder, partition.since, head)
            else:
                changes = [("add", p, None) for p in _names(git(folder, "ls-tree", "-r", "-z", "--name-only", head))]
                if partition.since:
                    yield (partition.url, head, "reset", f"{name}/", None, None, None, None)
            # a rename into or out of the selection is an addition or a deletion
            changes = [("add", p, None) if op == "rename" and not self.selected(old) else ("delete", old, None) if op == "rename" and not self.selected(p) else (op, p, old) for op, p, old in changes]
            changes = [c for c in changes if c[0] is not None and self.selected(c[1])]
            times = last_commits(folder, head, {p for op, p, _ in changes if op != "delete"})
            for operation, path, old in changes:
                at, size, content = None, None, None
                if operation != "delete":
                    file = Path(folder, path)
                    size = file.stat().st_size if file.is_file() else None
                    if size is None or size > self.max_bytes:
                        gone = [p for p in (path, old) if p] if known else []  # what was indexed before it grew
                        yield from ((partition.url, head, "delete", f"{name}/{p}", None, None, None, None) for p in gone)
                        continue
                    content = file.read_bytes()
                    at = datetime.fromisoformat(times[path]) if path in times else None
                # paths carry the repository, so that files of the same name in two repositories stay apart
                yield (partition.url, head, operation, f"{name}/{path}", f"{name}/{old}" if old else None, at, size, content)


class GitSource(DataSource):
    """spark.read.format("git").option("repos", "url,url").option("since", json of the last heads).load()"""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GitReader(self.options)
