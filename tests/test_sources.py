import json
import os
import shutil
import subprocess
from pathlib import Path

import pytest

from lodewright.operators import history, quarantine
from lodewright.operators.structure import inventory
from lodewright.sources import demo, files, gitlog


def test_tree(spark, tmp_path):
    for path, text in {"src/a.py": b"x = 1\n", "src/b c.ts": b"y", "node_modules/z.js": b"z", "notes.txt": b"t", "bad.md": b"\xff\xfeok", "big.sql": b"s" * 300}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text)
    got = {r.path: (r.size_bytes, r.content) for r in files.read_tree(spark, str(tmp_path), 7, max_bytes=200).collect()}
    assert sorted(got) == ["bad.md", "big.sql", "src/a.py", "src/b c.ts"]
    assert got["src/a.py"] == (6, "x = 1\n") and got["big.sql"] == (300, None) and got["bad.md"][1].endswith("ok")
    assert inventory(files.read_tree(spark, str(tmp_path), 7)).count() == 4


def test_logs_and_records(spark, tmp_path):
    ok = json.dumps({"type": "user", "sessionId": "s"})
    (tmp_path / "s.jsonl").write_text(f"{ok}\n{ok[:-1]}\n\n" + json.dumps({"type": "user", "sessionId": "s", "x": "y" * 500}) + "\n")
    raw = files.read_session_logs(spark, str(tmp_path), max_line=200)
    assert sorted((r.line_no, r.reason[:8]) for r in quarantine.unreadable(raw).collect()) == [(2, "not one "), (4, "not one ")]
    (tmp_path / "ADR-1.md").write_text("# T\n\nbody")
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path), 3).collect()] == [(3, "ADR-1.md", "# T\n\nbody")]


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_git_history(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "HOME": str(tmp_path)}

    def git(*args, at="2024-01-01T00:00:00+02:00"):
        subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at})

    git("init", "-q")
    Path(repo, "a b.py").write_text("1\n2\n")
    Path(repo, "bin.dat").write_bytes(bytes(range(256)))
    git("add", "-A")
    git("commit", "-q", "-m", "one\n\nwhy")
    Path(repo, "a b.py").write_text("1\n3\n4\n")
    git("add", "-A")
    git("commit", "-q", "-m", "two", at="2024-01-02T00:00:00+02:00")
    gitlog.register(spark)
    read = lambda t: spark.read.format("git_history").option("repos", f"5={repo}").option("table", t).load()
    commits = read("commits").collect()
    assert [(c.project_id, c.message, str(c.authored_at), c.position) for c in sorted(commits, key=lambda c: -c.position)] == [(5, "one\n\nwhy", "2023-12-31 22:00:00", 1), (5, "two", "2024-01-01 22:00:00", 0)]
    changed = read("commit_files").withColumnRenamed("sha", "commit_id")
    churned = history.file_churn(history.changes(read("commits").withColumnRenamed("sha", "commit_id"), changed))
    assert {r.path: (r.churn, r.commits, r.authors) for r in churned.collect()} == {"a b.py": (5, 2, 1), "bin.dat": (0, 1, 1)}
    blame = {(r.path, r.sha): r.n_lines for r in read("blame_lines").collect()}
    assert sorted(n for (p, _), n in blame.items() if p == "a b.py") == [1, 2]
    with pytest.raises(ValueError):
        gitlog.checked_revision("--upload-pack=x")


def test_demo_is_deterministic(spark):
    one, two = (sorted(map(tuple, demo.demo_commits(spark, 50, seed=s).collect())) for s in (3, 3))
    assert one == two and one != sorted(map(tuple, demo.demo_commits(spark, 50, seed=4).collect()))


def test_demo_touches_precede_their_commits(spark):
    from lodewright.operators import evidence as e
    from lodewright.sources.demo import demo_commits, demo_touches

    touches, commits = demo_touches(spark, 120, files=3), demo_commits(spark, 120, files=3)
    linked = e.link_forward(touches, commits.select("project_id", "path", "commit_id", "authored_at")).collect()
    assert len(linked) == touches.where("touch_kind <> 'read'").count() > 60
    assert all(r.linked_commit_id is not None and r.linked_commit_id <= r.touch_id and r.linked_at >= r.occurred_at for r in linked)
    assert sorted(map(str, touches.collect())) == sorted(map(str, demo_touches(spark, 120, files=3).collect()))
