import subprocess

import pytest

from millrace.api import Conflict, Engine, NotFound
from millrace.sources import config, folder, git, registry, web
from millrace.streaming import jobs


def test_folder_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "sub/b.txt").write_text("world")
    (tmp_path / "sub/c.bin").write_bytes(b"0" * 100)
    got = folder.files(spark, str(tmp_path), include=["*.md", "*.txt", "*.bin"], exclude=["sub/c*"])
    assert sorted((r.path, r.size) for r in got.collect()) == [("a.md", 5), ("sub/b.txt", 5)]
    assert [r.path for r in folder.files(spark, f"file://{tmp_path}", max_bytes=4).collect()] == []
    assert folder.inside("/r", "a/../b") == "/r/b"
    for bad in ("../x", "a/../../x", "/etc/x"):
        with pytest.raises(ValueError):
            folder.inside("/r", bad)


def test_object_listing(spark):
    rows = [("pre/a.md", 1, 5, '"e1"'), ("pre/dir/", 1, 0, '"e2"'), ("pre/big.md", 1, 99, '"e3"')]
    got = folder.objects(spark.createDataFrame(rows, "key string, modified int, size long, etag string"), "pre", ["*.md"], max_bytes=50).collect()
    assert [(r.path, r.etag) for r in got] == [("a.md", "e1")]


def run(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)


def test_git_source(spark, tmp_path):
    repo = tmp_path / "proj"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    (repo / "README.md").write_text("one")
    (repo / "gone.txt").write_text("two")
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "first")
    registry.register_data_sources(spark)
    first = spark.read.format("git").option("repos", str(repo)).load().collect()
    assert sorted((r.operation, r.path) for r in first) == [("add", "proj/README.md"), ("add", "proj/gone.txt")] and first[0].committed_at is not None
    (repo / "README.md").write_text("changed")
    run(repo, "rm", "-q", "gone.txt")
    run(repo, "commit", "-qam", "second")
    since = f'{{"{repo}": "{first[0].head}"}}'
    second = spark.read.format("git").option("repos", str(repo)).option("since", since).load().collect()
    assert sorted((r.operation, r.path, bytes(r.content or b"")) for r in second) == [("delete", "proj/gone.txt", b""), ("modify", "proj/README.md", b"changed")]


def test_repository_listing_follows_pages():
    pages = {1: [{"clone_url": "u1"}, {"clone_url": "u2"}], 2: [{"clone_url": "u2"}, {"clone_url": "u3"}]}
    asked = []

    def fetch(url, headers):
        asked.append((url, headers))
        return pages.get(int(url.rpartition("page=")[2]), [])

    assert git.list_repositories("github", "o", "t", fetch=fetch) == ["u1", "u2", "u3"]
    assert asked[0][1] == {"Authorization": "Bearer t"}
    with pytest.raises(ValueError):
        git.list_repositories("other", "o")


SITE = {
    "http://s/": (200, {"content-type": "text/html", "etag": "e"}, b'<a href="/a#x">a</a><a href="http://other/">o</a><a href="/no">n</a>'),
    "http://s/a": (200, {"content-type": "text/html; charset=x"}, b'<a href="/b">b</a>'),
    "http://s/b": (200, {"content-type": "text/html"}, b'<a href="/">root</a>'),
    "http://s/robots.txt": (200, {}, b"User-agent: *\nDisallow: /no"),
}


def visit(url, headers):
    return SITE.get(url, (404, {}, b""))


def test_crawl_rules():
    quiet = {"rate_limit": "1000/s", "sleep": lambda s: None}
    got = list(web.crawl("HTTP://S/#top", visit, **quiet))
    assert [(r[0], r[1], r[3]) for r in got] == [("http://s/", 0, "add"), ("http://s/a", 1, "add"), ("http://s/b", 2, "add")]
    assert [r[0] for r in web.crawl("http://s/", visit, max_depth=1, **quiet)] == ["http://s/", "http://s/a"]
    seen = {r[0]: r[4] for r in got}
    assert list(web.crawl("http://s/", visit, seen=seen, **quiet)) == []
    assert [r[3] for r in web.crawl("http://s/", visit, seen=seen | {"http://s/a": "old"}, **quiet)] == ["modify"]
    with pytest.raises(ValueError):
        list(web.crawl("http://s/", visit, max_depth=11))


def test_single_page():
    row = web.fetch_once("http://s/", {}, visit)
    assert row[3] == "add" and web.fetch_once("http://s/", {"hash": row[4]}, visit) is None
    assert web.fetch_once("http://s/", {"hash": "x"}, visit)[3] == "modify" and web.fetch_once("http://s/x", {}, visit)[-1] == "status 404"
    asked = {}
    assert web.fetch_once("u", {"etag": "e", "last_modified": "d"}, lambda u, h: asked.update(h) or (304, {}, b"")) is None
    assert asked["If-None-Match"] == "e" and asked["If-Modified-Since"] == "d"


def test_config():
    raw = {"core": {"chunker": {"strategy": "${S:-paragraph}"}}, "sources": [{"id": "${ID}", "plugin": "folder"}]}
    assert config.parse(raw, {"ID": "x"}) == {"core": {"chunker": {"strategy": "paragraph"}}, "sources": [{"id": "x", "plugin": "folder"}]}
    with pytest.raises(config.ConfigError, match=r"sources\[0\]\.id: the environment has no ID"):
        config.parse(raw, {})
    with pytest.raises(config.ConfigError, match=r"core\.chunker\.size: unknown; sources\[0\]: plugin is missing"):
        config.parse({"core": {"chunker": {"size": 1}}, "sources": [{"id": "x"}]}, {})
    assert config.filled("a${X}b${Y:-}c${1}${Z", {"X": "1"}) == "a1bc${1}${Z"
    assert config.chunker(raw, {"CHUNK_SIZE_TOKENS": "9"})["chunk_size_tokens"] == 9 and config.chunker({}, {})["overlap_tokens"] == 50


def test_registry():
    r = registry.Registry()
    plugin = type("P", (), {"plugin_id": "p", "extensions": (".x",), "priority": 3})
    r.register("extractor", "n", plugin)
    assert r.get("extractor", "n") is plugin and r.get("extractor", "p") is plugin and r.names("extractor") == ["n"]
    assert r.capabilities()["n"]["priority"] == 3
    with pytest.raises(KeyError):
        r.get("source", "none")


def test_engine_end_to_end(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("rivers and mills")
    (src / "b.txt").write_text("water wheels turn")
    e = Engine(spark, str(tmp_path / "data"))
    id_ = e.add_source("folder", "one", folder_path=str(src))
    with pytest.raises(Conflict):
        e.add_source("folder", "one")
    with pytest.raises(ValueError):
        e.add_source("s3", "two")
    assert sorted(r.operation for r in e.sync(id_).collect()) == ["add", "add"]
    assert e.search_semantic("water wheels", top_k=1).first().path == "b.txt"
    assert [r.path for r in e.search_lexical("mils").collect()] == ["a.md"]
    assert "### b.txt" in e.rag_ask("water wheels")["context"]
    (src / "a.md").unlink()
    assert [r.operation for r in e.sync(id_).collect()] == ["delete"]
    assert e.stats()["total"] == 2 and e.purge(id_) == {"vectors": 1, "lexical": 1} and e.health()["status"] == "healthy"
    with pytest.raises(NotFound):
        e.purge("other")
    with pytest.raises(ValueError):
        e.search_semantic("x", modality="image")
    with e.lock(id_), pytest.raises(Conflict), e.lock(id_):
        pass


def test_engine_keeps_failures_and_tries_again(spark, tmp_path):
    """A broken file is kept with its bytes, counts as unseen, and waits for its turn; what is mended is indexed."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.docx").write_bytes(b"no archive")
    (src / "b.txt").write_text("granite")
    e = Engine(spark, str(tmp_path / "data"))
    id_ = e.add_source("folder", "one", folder_path=str(src))
    e.sync(id_)
    dead = e.read("dead").collect()
    assert [(r.path, bytes(r.content), r.retry_count) for r in dead] == [("a.docx", b"no archive", 0)] and dead[0].error
    assert e.sync(id_).count() == 0  # its bytes are in the letter, from which it is tried again
    assert e.drain() == {"again": 0, "waiting": 1, "final": 0} and e.stats()["dead"] == 1
    from pyspark.sql import functions as F

    later = lambda s: F.timestamp_seconds(F.unix_timestamp(F.current_timestamp()) + s)
    for k, wait in enumerate((60, 300, 900)):  # one letter, tried after one, five and fifteen minutes
        assert e.drain(later(wait - 30))["waiting"] == 1
        assert e.drain(later(wait + 30)) == {"again": 1, "waiting": 0, "final": 0}
        assert [r.retry_count for r in e.read("dead").collect()] == [k + 1]
    assert e.drain(later(10**6)) == {"again": 0, "waiting": 0, "final": 1} and e.stats()["final"] == 1
    assert e.list_files().count() == 1 and e.read("cache").count() == 1
    (src / "a.docx").write_bytes(b"broken in another way")
    e.sync(id_)
    assert [(bytes(r.content), r.retry_count) for r in e.read("dead").collect()] == [(b"broken in another way", 0)]
    (src / "a.docx").unlink()
    e.sync(id_)
    assert e.read("dead").count() == 0


def test_engine_records_what_it_does_not_index(spark, tmp_path):
    """Images leave a row; a document that loses its text loses its chunks."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.png").write_bytes(b"\x89PNG")
    (src / "b.txt").write_text("granite")
    e = Engine(spark, str(tmp_path / "data"))
    id_ = e.add_source("folder", "one", folder_path=str(src))
    e.sync(id_)
    assert [(r.path, r.route) for r in e.read("unrouted").collect()] == [("a.png", "image")]
    (src / "b.txt").write_text(" ")
    e.sync(id_)
    assert e.list_files().count() == 0 and e.stats()["total"] == 0 and not e.stats()["errors"]
    assert e.search_lexical("granite").count() == 0


def test_engine_syncs_git_and_opens_changed_files_only(spark, tmp_path, monkeypatch):
    repo = tmp_path / "proj"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    (repo / "README.md").write_text("mills on rivers")
    (repo / "old name.md").write_text("a page about granite and slate that stays as it is")
    (repo / "skip.bin").write_text("x")
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "first")
    e = Engine(spark, str(tmp_path / "data"))
    id_ = e.add_source("git", "g", url=str(repo), file_patterns=["*.md"])
    assert sorted((r.path, r.operation) for r in e.sync(id_).collect()) == [("proj/README.md", "add"), ("proj/old name.md", "add")]
    run(repo, "mv", "old name.md", "new.md")
    run(repo, "commit", "-qm", "second")
    assert sorted((r.path, r.operation) for r in e.sync(id_).collect()) == [("proj/new.md", "add"), ("proj/old name.md", "delete")]
    assert [r.path for r in e.search_lexical("granite").collect()] == ["proj/new.md"]
    assert e.sync(id_).count() == 0
    src = tmp_path / "src"
    src.mkdir()
    (src / "a[1].md").write_text("one")
    (src / "b.md").write_text("two")
    paths = spark.createDataFrame([("a[1].md",)], "path string")
    assert [(r.path, bytes(r.content)) for r in folder.contents(spark, str(src), paths).collect()] == [("a[1].md", b"one")]


def test_git_after_a_force_push_and_files_of_odd_names_and_sizes(spark, tmp_path):
    """A head that is gone counts as a first sight, and what is lost is deleted; odd names come as they are; a file that grows too large leaves the index."""
    repo = tmp_path / "proj"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    (repo / "a.md").write_text("granite")
    (repo / 'tab\there "x"\nline.md').write_text("slate")
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "first")
    e = Engine(spark, str(tmp_path / "data"))
    id_ = e.add_source("git", "g", url=str(repo), file_patterns=["*.md"])
    odd = 'proj/tab\there "x"\nline.md'
    rows = e.sync(id_).collect()
    assert sorted((r.path, r.operation) for r in rows) == [("proj/a.md", "add"), (odd, "add")] and all(r.content_modified_at for r in rows)
    run(repo, "checkout", "-q", "--orphan", "other")
    run(repo, "rm", "-q", "--cached", "a.md")
    (repo / "a.md").unlink()
    (repo / "b.md").write_text("gneiss")
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "other")
    run(repo, "branch", "-M", "other", "main")
    run(repo, "-c", "gc.reflogExpire=now", "reflog", "expire", "--expire=now", "--all")
    run(repo, "gc", "-q", "--prune=now")
    assert sorted((r.path, r.operation) for r in e.sync(id_).collect()) == [("proj/a.md", "delete"), ("proj/b.md", "add"), (odd, "add")]
    assert sorted(r.path for r in e.list_files().collect()) == ["proj/b.md", odd]
    from millrace.sources.git import GitReader, Repository, git

    head = git(repo, "rev-parse", "HEAD").strip()
    (repo / "b.md").write_text("x" * 1000)
    run(repo, "add", ".")
    run(repo, "commit", "-qm", "grows")
    assert [(r[2], r[3]) for r in GitReader({"repos": str(repo), "maxBytes": "100"}).read(Repository(str(repo), head))] == [("delete", "proj/b.md")]


def test_streaming_dedup_and_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k":"a","at":"2024-01-01T00:00:00Z"}\n{"k":"a","at":"2024-01-01T01:00:00Z"}\nnonsense\n{"k":"b","at":"2024-01-01T02:00:00Z"}\n')
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    stream = jobs.read_json_lines(spark, str(tmp_path / "in"), StructType([StructField("k", StringType()), StructField("at", TimestampType())]))
    got, bad = [], []

    def write(batch, _):
        got.extend(r.k for r in batch.collect())

    jobs.run_batches(jobs.unique_within(stream.where("not _bad"), "k", "at"), write, str(tmp_path / "c1")).awaitTermination()
    jobs.run_batches(stream.where("_bad"), lambda b, _: bad.extend(r._raw for r in b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert sorted(got) == ["a", "b"] and bad == ["nonsense"]
