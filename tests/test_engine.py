"""A small project end to end: build, search, edit, stats, streaming versions, sources."""

import json
import subprocess
import zlib

import pytest

from siftwood.functions import embed
from siftwood.operators import chunk
from siftwood.plans import engine as engines
from siftwood.plans import evaluation
from siftwood.plans.engine import Engine, get_context
from siftwood.sources import corpus, pdf, sinks
from siftwood.streaming import versions

VAULT = '''import time


class KeyVault:
    """Holds signing keys and rotates them."""

    def __init__(self, ring):
        self.ring = ring

    def rotate_keys(self, now):
        """Replace keys that are past their lifetime."""
        return [k for k in self.ring if k.expires > now]
'''
SHIP = "// Sends a parcel and returns its label.\nexport function bookParcel(order: Order) {\n  const label = carrier.book(order);\n  order.label = label;\n  return label;\n}\n"
MANUAL = "# Manual\n\nWelcome aboard.\n\n## Warehouse map\n\n![floor plan](floor.png)\n\n```\n# not a heading\nrun.sh\n```\nHow to read the floor plan of the warehouse.\n"


@pytest.fixture
def project(tmp_path):
    for name, text in {"src/vault.py": VAULT, "web/ship.ts": SHIP, "docs/manual.md": MANUAL, "tests/test_vault.py": "def test_rotate_keys():\n    rotate_keys = 1\n    assert rotate_keys\n"}.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = tmp_path / "p"
    (tmp_path / "outside.txt").write_text("secret elsewhere")
    (root / "link.txt").symlink_to(tmp_path / "outside.txt")
    (root / "blob.txt").write_bytes(b"a\0b")
    (root / "a b%20[c].txt").write_text("odd name of a file about marmalade\n")
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    return root


def test_search_finds_and_follows_edits(spark, project):
    engine = Engine(spark, project)
    assert engine.build() == {"changed": 7 - 1, "removed": 0, "files": 6}
    assert engine.throughput["files"] == 6 and engine.throughput["chunks"] == engine.chunks().count() and engine.throughput["chunks_per_second"] > 0
    top = engine.search("rotate_keys", 3).orderBy("place").collect()
    assert top[0].path == "src/vault.py" and top[0].line_start <= 10 <= top[0].line_end
    assert "tests/test_vault.py" in {r.path for r in top}
    outline = engine.search("replace keys past lifetime", 1, "outline").first()
    assert outline.snippet.splitlines()[0] == "class KeyVault:" and "def rotate_keys(self, now):" in outline.snippet
    assert engine.search("key vault", 1).first().path == "src/vault.py"
    assert engine.search("bookParcel", 1).first().path == "web/ship.ts"
    manual = engine.search("how to read the warehouse floor plan", 1).first()
    assert manual.path == "docs/manual.md" and "1 image(s)" in manual.note and "# not a heading" in manual.snippet
    assert engine.search("marmalade", 1).first().path == "a b%20[c].txt"

    (project / "web/ship.ts").write_text(SHIP.replace("bookParcel", "cancelParcel"))
    (project / "docs/manual.md").unlink()
    assert engine.search("cancelParcel", 1).first().path == "web/ship.ts"
    stats = engine.stats()
    assert stats["files"] == 5 and stats["chunks"] == engine.chunks().count() and stats["last_indexed"]
    assert engine.build() == {"changed": 0, "removed": 0, "files": 5}


def test_searches_and_snapshots_outlive_edits(spark, project):
    engine = Engine(spark, project, lease=300)
    engine.build()
    before = engine.search("bookParcel", 1)
    with Engine(spark, project, lease=0).snapshot() as held:
        chunks = held.chunks().count()
        for n in range(3):
            (project / "web/ship.ts").write_text(SHIP.replace("bookParcel", f"cancelParcel{n}"))
            engine.build()
        assert held.chunks().count() == chunks and before.first().path == "web/ship.ts"
    assert "cancelParcel2" in engine.search("cancelParcel2", 1).first().snippet


def test_bounded_search_is_the_same(spark, project, monkeypatch):
    engine = Engine(spark, project)
    want = [tuple(r) for r in engine.search("rotate keys of the vault", 5).orderBy("place").collect()]
    monkeypatch.setattr(engines, "BOUNDED_CHUNKS", 0)
    assert [tuple(r) for r in engine.search("rotate keys of the vault", 5).orderBy("place").collect()] == want


def test_bad_queries_and_result_forms(spark, project):
    with pytest.raises(ValueError, match="empty"):
        Engine(spark, project).search("  ")
    with pytest.raises(ValueError, match="detail"):
        Engine(spark, project).search("x", detail="half")
    got = get_context(spark, "bookParcel", 0, project)
    assert len(got) == 1 and set(got[0]) == {"path", "line_start", "line_end", "snippet", "score", "kind"}
    rows = Engine(spark, project).search("how to read the floor plan", 2)
    assert json.loads(sinks.result_json(rows).first().results)[0]["path"] == "docs/manual.md"
    assert sinks.print_results([]) == "no results"
    assert sinks.print_results(rows.orderBy("place").collect()).startswith("docs/manual.md:5-13\n  ## Warehouse map")


def test_another_model_rebuilds_and_choice_is_kept(spark, project):
    Engine(spark, project).build()
    other = Engine(spark, project, model="hashed-256")
    assert other.build()["changed"] == 6 and len(other.chunks().first().vec) == 256
    other.configure(model="hashed-256")
    again = Engine(spark, project)
    assert again.model == "hashed-256" and again.build()["changed"] == 0


def test_stream_of_versions(spark, project, tmp_path):
    engine = Engine(spark, project, index=str(tmp_path / "index"))
    log = tmp_path / "log"
    log.mkdir()

    def say(name, *rows):
        keys = ("path", "mtime", "size", "text", "deleted")
        (log / name).write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))
        stream = spark.readStream.schema(versions.SCHEMA).json(str(log))
        versions.follow(stream, engine, str(tmp_path / "checkpoint")).awaitTermination()

    say("1.json", ("a.txt", 1.0, 3, "old words", False), ("b.txt", 1.0, 3, "bees", False), ("a.txt", 2.0, 3, "new words", False))
    assert {r.text for r in engine.chunks().collect()} == {"new words", "bees"}
    say("2.json", ("b.txt", 3.0, 0, None, True), ("c.txt", 3.0, 1, "sea", False))
    assert {r.path for r in engine.chunks().collect()} == {"a.txt", "c.txt"}
    assert engine.search("sea", 1, refresh=False).first().path == "c.txt"
    say("3.json", ("c.txt", 2.0, 1, "lake", False), ("b.txt", 2.5, 1, "wasps", False), ("d.txt", 1.0, 1, "first", False), ("d.txt", 1.0, 2, "second", False))
    assert {r.text for r in engine.chunks().collect()} == {"new words", "sea", "second"}


def test_root_and_listing(spark, tmp_path):
    outer = tmp_path / "o"
    (outer / corpus.INDEX_DIR).mkdir(parents=True)
    inner = outer / "in" / "deep"
    inner.mkdir(parents=True)
    (outer / "in" / ".git").mkdir()
    assert corpus.find_root(inner) == outer.resolve()
    plain = tmp_path / "plain"
    for name in ("a.py", "b.log", "node_modules/x.js", ".hid/y.py", "out/z.py", "keep/c.min.js", "keep/d.py"):
        (plain / name).parent.mkdir(parents=True, exist_ok=True)
        (plain / name).write_text("x")
    (plain / ".gitignore").write_text("*.log\n/out/\n")
    assert sorted(r.path for r in corpus.listing(spark, plain).collect()) == [".gitignore", "a.py", "keep/d.py"]


def test_cases_overlay_and_runs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"repos": {"a": {"url": "u", "commit": "1"}}, "cases": [{"repo": "a", "q": "q1", "targets": [["p"], ["p", 3], ["p", "def x"]], "rephrasings": ["r"]}]}, indent=1))
    (tmp_path / "o.json").write_text(json.dumps({"repos": {"a": {"url": "v", "commit": "2"}, "b": {"url": "w", "commit": "3"}}, "cases": [{"repo": "b", "q": "q2", "targets": [], "split": "dev"}]}))
    cases, repos = corpus.read_cases(spark, str(tmp_path / "c.json"), str(tmp_path / "o.json"))
    assert {(r.name, r.url) for r in repos.collect()} == {("a", "v"), ("b", "w")}
    assert {(r.q, r.split) for r in cases.collect()} == {("q1", None), ("q2", "dev")}
    targets = [(r.path, r.line, r.pattern) for r in corpus.typed_targets(cases).collect()]
    assert targets == [("p", None, None), ("p", 3, None), ("p", None, "def x")]
    (tmp_path / "runs.jsonl").write_text('{"case":"a-1","arm":"on","rep":0,"answers":[["x.py",1,5]],"tools":{"grep":2}}\n\n')
    runs = corpus.read_runs(spark, str(tmp_path / "runs.jsonl"))
    corpus.append_runs(runs, str(tmp_path / "more"))
    again = corpus.read_runs(spark, str(tmp_path / "more")).first()
    assert (again.answers[0].path, again.answers[0].start, again.answers[0].end, again.tools) == ("x.py", 1, 5, {"grep": 2})


def test_store_scan(spark, project):
    got = {r.path for r in corpus.texts_of(corpus.scan_store(spark, str(project))).collect()}
    assert {"src/vault.py", "docs/manual.md"} <= got and "blob.txt" not in got and not any(".git/" in p for p in got)


def test_a_build_that_stops_goes_on(spark, project, monkeypatch):
    monkeypatch.setattr(engines, "BATCH_BYTES", 1)
    engine, store, done = Engine(spark, project), Engine._store, []

    def stops(self, *args):
        if len(done) == 2:
            raise RuntimeError("stopped")
        done.append(args)
        return store(self, *args)

    monkeypatch.setattr(Engine, "_store", stops)
    with pytest.raises(RuntimeError):
        engine.build()
    monkeypatch.setattr(Engine, "_store", store)
    held = engine.stats()["files"]
    assert 2 <= held < 6
    assert engine.build()["changed"] == 6 - held and engine.stats()["files"] == 6
    assert engine.search("bookParcel", 1).first().path == "web/ship.ts"


def pdf_file(*pages):
    """A PDF of pages (text or None, images)."""
    kids = " ".join(f"{10 * n} 0 R" for n in range(1, len(pages) + 1))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()}
    for n, (text, images) in enumerate(pages, 1):
        names = " ".join(f"/Im{i} 5 0 R" for i in range(images))
        shown = "".join(f"BT /F1 12 Tf ({line}) Tj ET " for line in (text or "").split("\n") if line) + "".join(f"/Im{i} Do " for i in range(images))
        packed = zlib.compress(shown.encode("cp1252"))
        objects[10 * n] = f"<< /Type /Page /Parent 2 0 R /Resources << /XObject << {names} >> >> /Contents {10 * n + 1} 0 R >>".encode()
        objects[10 * n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
    objects[5] = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 >>\nstream\nx\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + body + b"\nendobj\n" for n, body in objects.items())


def test_pages_of_pdfs_are_found(spark, project):
    assert pdf.read_pages(pdf_file(("caf\xe9 \\(one\\)\ntwo", 0), (None, 2))) == [(1, "caf\xe9 (one)\ntwo", 0), (2, "", 2)]
    (project / "scan.pdf").write_bytes(pdf_file((None, 1), ("how turbines are serviced", 1)))
    (project / "broken.pdf").write_bytes(b"not one at all")
    engine = Engine(spark, project)
    engine.build()
    found = engine.search("turbines serviced", 1).first()
    assert (found.path, found.page, found.line_start, found.kind) == ("scan.pdf", 2, 2, "pdf_page") and "this page also contains 1 image(s)" in found.note
    scan = engine.chunks().filter("path = 'scan.pdf' AND line_start = 1").first()
    assert scan.images == 1 and scan.text == chunk.EMPTY_PAGE.format(1)
    assert engine.chunks().filter("path = 'broken.pdf'").count() == 0


def test_nested_ignore_files(spark, tmp_path):
    for name in ("a.txt", "b/c.txt", "b/d.txt", "b/e/f.txt", "x/y/z.txt", "x/y/w.md", "gen/q.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("x/**/*.txt\ngen/\n.gitignore\nd.txt\n")
    (tmp_path / "b" / ".gitignore").write_text("!d.txt\n/e\n")
    assert sorted(r.path for r in corpus.listing(spark, tmp_path).collect()) == ["a.txt", "b/c.txt", "b/d.txt", "x/y/w.md"]


def test_model_vectors_keep_the_order_of_the_texts():
    np = pytest.importorskip("numpy")

    class Coded:
        def __init__(self, ids, length):
            self.ids, self.type_ids = ids + [0] * (length - len(ids)), [0] * length
            self.attention_mask = [1] * len(ids) + [0] * (length - len(ids))

    class Words:
        def enable_truncation(self, most):
            self.most = most

        def enable_padding(self):
            self.padded = True

        def encode_batch(self, texts):
            rows = [[len(w) for w in t.split()][: self.most] for t in texts]
            return [Coded(r, max(map(len, rows))) for r in rows]

    class Session:
        class Named:
            def __init__(self, name):
                self.name = name

        widths: list = []

        def get_inputs(self):
            return [self.Named("input_ids"), self.Named("attention_mask")]

        def get_outputs(self):
            return [self.Named("states")]

        def run(self, outputs, feed):
            assert outputs == ["states"] and set(feed) == {"input_ids", "attention_mask"}
            self.widths.append(feed["input_ids"].shape)
            ids = feed["input_ids"].astype("float32")
            return [np.stack([ids, ids + 1], axis=2)]

    texts = [" ".join(["abc"] * n) for n in range(20, 0, -1)] + ["a bcd"]
    got = embed.TextModel(Session(), Words()).vectors(texts)
    want = [np.array([m, m + 1]) for m in [3] * 20 + [2]]
    assert np.allclose(got, [w / np.linalg.norm(w) for w in want]) and got.dtype == np.float32
    assert [s[0] for s in Session.widths] == [8, 8, 5] and Session.widths[0][1] < 10
    assert np.allclose(embed.TextModel(Session(), Words(), "cls").vectors(["abc d"]), [[0.6, 0.8]])


def test_evaluation_of_projects(spark, project):
    kind = "repo string, q string, targets array<array<string>>, split string"
    cases = spark.createDataFrame(
        [
            ("p", "rotate_keys", [["src/vault.py", "def rotate_keys"]], "test"),
            ("p", "where is a parcel booked", [["web/ship.ts", "2"]], "test"),
            ("p", "how to read the floor plan of the warehouse", [["docs/manual.md"]], "dev"),
            ("p", "marmalade", [["src/vault.py", "1"]], "test"),
        ],
        kind,
    )
    repos = spark.createDataFrame([("p", "u", "1")], "name string, url string, commit string")
    rows = evaluation.evaluated(spark, cases, repos, {"p": project}, 1).persist()
    got = {r.case_id: r for r in rows.collect()}
    by_q = {q: got[f"p-{zlib.crc32(q.encode()):08x}"] for q in ("rotate_keys", "marmalade", "how to read the floor plan of the warehouse")}
    assert by_q["rotate_keys"]["rank"] == 1 and by_q["rotate_keys"].shows is True and by_q["rotate_keys"].hit > 0
    assert by_q["marmalade"]["rank"] is None and by_q["marmalade"].full_read == by_q["marmalade"].full + by_q["marmalade"].file
    assert by_q["how to read the floor plan of the warehouse"]["rank"] == 1 and by_q["how to read the floor plan of the warehouse"].shows is None
    out = {(r.split, r.repo): r for r in evaluation.report(rows, 3).collect()}
    assert out["test", "p"].n == out["test", "ALL"].n == 3 and out["dev", "ALL"].hit_1 == 1.0 and out["test", "ALL"].shown is not None and out["dev", "ALL"].shown is None
    with pytest.raises(ValueError, match="no folder for p"):
        evaluation.evaluated(spark, cases, repos, {})
    with pytest.raises(Exception, match="no such repository"):
        corpus.cases_of_repos(cases, repos.filter("name = 'q'")).collect()
