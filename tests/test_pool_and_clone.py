"""Batches that go on from their log, and clones of a repository on this machine."""

import json
import subprocess
import threading

import pytest

from lexispark.pool import Pool
from lexispark.sources.clone import clone, sparse_patterns


def test_a_pool_stops_at_its_target_and_goes_on_from_its_log():
    lines, begun, running, most, lock = [], [], [0], [0], threading.Lock()

    def ensure(library):
        with lock:
            begun.append(library)
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            if library == "/f":
                raise RuntimeError("no")
            return "skipped" if library == "/s" else "succeeded"
        finally:
            with lock:
                running[0] -= 1

    every = ["/A", "/f", "/s", *[f"/{k}" for k in range(20)]]
    assert Pool(ensure, lines.append, target=4, workers=3).run(every, ['{"libraryId": "/a", "status": "succeeded"}', "nonsense", "[]"]) == 4
    assert "/A" not in begun and 1 <= most[0] <= 3
    events = [json.loads(x) for x in lines]
    assert [e["status"] for e in events].count("succeeded") == 3
    assert [e["error"] for e in events if e["libraryId"] == "/f"] == ["no"]
    again = []
    assert Pool(lambda x: again.append(x) or "succeeded", lines.append, target=6, retry_failed=True).run(["/f", *every], lines) == 6
    assert again[0] == "/f" and len(again) == 3


def git(at, *args):
    subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *args], cwd=at, check=True, capture_output=True)


def test_a_clone_has_documentation_and_settings_only(tmp_path):
    src = tmp_path / "src"
    for name in ("docs/a.md", "src/main.py", "package.json", "README.rst", "data/big.bin"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(name)
    git(src, "init", "-q", "-b", "main")
    git(src, "add", "-A")
    git(src, "commit", "-qm", "one")
    git(src, "tag", "v1")
    (src / "docs/b.md").write_text("later")
    git(src, "add", "-A")
    git(src, "commit", "-qm", "two")
    to = tmp_path / "to"
    sha = clone(f"file://{src}", str(to))
    assert len(sha) == 40
    found = {str(p.relative_to(to)) for p in to.rglob("*") if p.is_file() and ".git/" not in f"{p}/"}
    assert found == {"docs/a.md", "docs/b.md", "package.json", "README.rst"} and "*.md" in sparse_patterns()
    old = clone(f"file://{src}", str(tmp_path / "old"), "v1")
    assert old != sha and not (tmp_path / "old/docs/b.md").exists()
    with pytest.raises(FileExistsError):
        clone(f"file://{src}", str(to))
    with pytest.raises(subprocess.CalledProcessError):
        clone(f"file://{tmp_path}/none", str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists()
