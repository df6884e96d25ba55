import io
import json
import os

import pytest
from pyspark.sql import functions as F

from lodewell import cli, formatting
from lodewell.config import Settings, expand_home, portable
from lodewell.embedder import HashingEmbedder
from lodewell.errors import ConfigError, EmbedError, StorageError
from lodewell.server import Server
from lodewell.sources import scan
from lodewell.sources.index import Index, search_workspaces
from lodewell.streaming.incremental import follow


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "ws"
    for p, t in {"a.py": "def alpha():\n    return 'parse the tokens'\n\n\ndef beta():\n    return 2\n", "doc/b.md": "# Parsing tokens\nhow to parse the tokens\n\n# Other\nunrelated words here\n", "target/no.py": "def no(): pass\n", ".git/x.py": "def no(): pass\n", ".hidden.py": "def hidden():\n    pass\n", "big.py": "#" * 2_000_000, "c.txt": "none", "bin.py": b"\x7fELF..", "bad.py": b"\xff\xfe def"}.items():
        at = r / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(t if isinstance(t, bytes) else t.encode())
    return r


def settings():
    s = Settings()
    s.search.min_score = 0.05
    return s


def test_scan(spark, root):
    found = scan.scan(spark, str(root), ["py", "md"])
    assert {r.rel_path for r in found.select("rel_path").collect()} == {"a.py", "doc/b.md", ".hidden.py", "bin.py", "bad.py"}
    assert {r.rel_path for r in scan.readable(found).collect()} == {"a.py", "doc/b.md", ".hidden.py"}
    exact = os.path.getsize(root / "a.py")
    assert scan.scan(spark, str(root), ["py"], exact).where("rel_path = 'a.py'").count() == 1
    assert scan.scan(spark, str(root), ["py"], exact - 1).where("rel_path = 'a.py'").count() == 0


def test_life_of_an_index(spark, root, tmp_path):
    index = Index(spark, str(tmp_path / "ix"), HashingEmbedder(64), settings())
    first = index.reindex(str(root))
    assert first["new"] == 5 and first["chunks"] == 5 and first["cache_hits"] == 0
    again = index.reindex(str(root))
    assert again["chunks"] == 0 and again["new"] == again["changed"] == 0
    assert index.version() == "v-000000000001"
    hit = index.search("parse the tokens", query_prefix="").first()
    assert hit["rank"] == 1 and hit.source_path in ("a.py", "doc/b.md")
    assert {r.source_path for r in index.search("parse the tokens", prefix="doc/").collect()} == {"doc/b.md"}

    (root / "a.py").write_text("def gamma():\n    return 3\n")
    os.remove(root / "doc/b.md")
    after = index.reindex(str(root))
    assert (after["changed"], after["deleted"], after["chunks"]) == (1, 1, 1)
    fresh = Index(spark, str(tmp_path / "ix2"), HashingEmbedder(64), settings())
    fresh.reindex(str(root))
    rows = lambda i, t: sorted(map(str, i.table(t).drop("created_at", "community_id").collect()))
    assert rows(index, "chunks") == rows(fresh, "chunks") and rows(index, "vectors") == rows(fresh, "vectors")
    both = search_workspaces({"x": index, "y": fresh}, "gamma").collect()
    assert {r.workspace for r in both} == {"x", "y"}

    with pytest.raises(StorageError):
        Index(spark, str(tmp_path / "ix"), HashingEmbedder(32)).search("x")
    assert index.gc_cache(30) == 0 and index.gc_cache(-1) == index.table("cache").count() + 6 or index.table("cache").count() == 0
    assert index.vacuum() >= 1


def test_notes_and_server(spark, root, tmp_path):
    server = Server(Index(spark, str(tmp_path / "ix"), HashingEmbedder(64), settings()), str(root))
    tool = lambda name, **a: server.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    text = lambda name, **a: tool(name, **a)["content"][0]["text"]
    assert text("search_code", query="x") == formatting.NO_CHUNKS and text("check_notes", query="x") == formatting.NO_NOTES
    assert text("note_to_self", text="remember the parser", tags=["a", 5, "b"]).startswith("Note saved")
    assert "[a, b] (ts: " in text("check_notes", query="parser")
    assert "new: 5" in text("index_workspace")
    assert text("search_code", query="parse the tokens", top_k=2).startswith("[0.") or "`" in text("search_code", query="parse the tokens", top_k=2)
    assert tool("search_code")["isError"] and tool("nope")["isError"]
    assert server.handle({"method": "notifications/initialized"}) is None and server.handle({"method": "what"}) is None
    assert server.handle({"id": 3, "method": "what"})["error"]["code"] == -32601
    out = io.StringIO()
    server.serve(io.StringIO('\nnot json\n{"id": 1, "method": "initialize"}\n{"id": 2, "method": "tools/list"}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2] and len(replies[1]["result"]["tools"]) == 4


def test_embedder():
    e = HashingEmbedder(32)
    assert e.embed("some words") == e.embed_batch(["x", "some words"])[1] and abs(sum(x * x for x in e.embed("a b c")) - 1) < 1e-9
    assert e.embed("Café") == e.embed("cafe") and not any(e.embed_batch([""])[0])
    with pytest.raises(EmbedError):
        e.embed(" ")


def test_settings(tmp_path):
    at = tmp_path / "c.toml"
    assert Settings.load(at) == Settings()
    s = Settings()
    s.index.workspaces, s.search.top_k, s.model.dir = ["~/x"], 9, 'a"b'
    s.save(at)
    assert Settings.load(at) == s
    at.write_text("[search]\ntop_k = 3\nmin_score = 0.5\n")
    assert Settings.load(at).search.mmr_lambda == 0.8
    for bad in ("[search]\ntop_k = 3\n", "[search\n"):
        at.write_text(bad)
        with pytest.raises(ConfigError):
            Settings.load(at)
    assert expand_home("~/a", "/h") == "/h/a" and portable("/h/a", "/h") == "~/a" and portable("/hx", "/h") == "/hx"


def test_cli(tmp_path):
    s = Settings()
    assert cli.repos(s, "add-repo", "~/x", "/h") == "added ~/x" and cli.repos(s, "add-repo", "/h/x", "/h") == "~/x is there already" and cli.repos(s, "remove-repo", "~/x", "/h") == "removed ~/x"
    args = cli.parser().parse_args(["query", "--json"])
    assert cli.prompt(args, io.StringIO('{"prompt": "p"}')) == "p"
    with pytest.raises(SystemExit):
        cli.prompt(args, io.StringIO("{}"))
    assert json.loads(formatting.hook_response("e", None)) == {"continue": True}


def test_follow(spark, root, tmp_path):
    seen = []
    q = follow(spark, str(root), str(tmp_path / "log"), lambda df, n: seen.extend(r[0].rsplit("/", 1)[-1] for r in df.select("path").collect()), per_batch=3)
    q.awaitTermination()
    assert "a.py" in seen and len(seen) == len(set(seen))
    before = len(seen)
    (root / "new.py").write_text("x = 1\n")
    follow(spark, str(root), str(tmp_path / "log"), lambda df, n: seen.extend(r[0].rsplit("/", 1)[-1] for r in df.select("path").collect())).awaitTermination()
    assert seen[before:] == ["new.py"]


def test_flat_format_of_nothing(spark):
    empty = spark.createDataFrame([], "rank int, score double, kind string, name string, source_path string, source string, community_id long")
    assert formatting.flat(empty).first()[0] == "" and formatting.grouped(empty).first()[0] == "" and formatting.tool(empty).first()[0] == formatting.NO_HITS
    row = empty.union(spark.createDataFrame([(1, 0.5, "function", "f", "a.rs", "fn f() {}", 3)], empty.schema)).withColumn("score", F.col("score"))
    assert formatting.grouped(row).first()[0] == "── Community 3 ──\n[0.50] function `f` — a.rs\nfn f() {}"
    assert formatting.tool(row).first()[0] == "[0.50] [community 3] function `f` — a.rs\nfn f() {}"
