"""Archives read by ranges of their members."""

import json
import random
import zipfile

import pytest

from plumbline.sources import archives, readers


@pytest.fixture
def archive(tmp_path):
    rng = random.Random(4)
    docs = {f"d/CIK{n:03}.json": {"cik" if n % 3 else "other": n, "text": "é" * rng.randint(0, 3000) + str(rng.random())} for n in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n, (name, doc) in enumerate(docs.items()):
            z.writestr(name, json.dumps(doc), zipfile.ZIP_DEFLATED if n % 2 else zipfile.ZIP_STORED)
        z.writestr("d/", "")
        z.writestr("readme.txt", "no")
    return str(tmp_path / "a.zip"), docs


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_members(spark, archive, scheme):
    path, docs = archive
    got = {r.member: json.loads(r.doc) for r in readers.zipped_json(spark, scheme + path).collect()}
    assert got == docs
    some = readers.zipped_json(spark, scheme + path, members=["d/CIK003.json", "d/CIK004.json", "none.json"], need="cik").collect()
    assert [(r.member, r.too_large) for r in some] == [("d/CIK004.json", False)]
    sizes = {n: len(json.dumps(d)) for n, d in docs.items()}
    limited = {r.member: (r.doc is None, r.too_large) for r in readers.zipped_json(spark, scheme + path, limit=4000).collect()}
    assert limited == {n: (s > 4000, s > 4000) for n, s in sizes.items()} and 0 < sum(s > 4000 for s in sizes.values()) < 60


def test_one_archive_feeds_many_tasks(archive, monkeypatch):
    path, docs = archive
    monkeypatch.setattr(archives, "PART_BYTES", 20_000)
    parts = list(archives.planned(path, None, ".json", 1 << 40))
    assert len(parts) > 3 and [r[0] for p in parts for r in p.ranges] == list(docs)
    assert len(list(archives.planned(path, {"d/CIK001.json"}, ".json", 1 << 40))) == 1


def test_only_ranges_are_read(archive):
    """A task touches its members' bytes, not the rest of the archive."""
    path, docs = archive
    part = next(archives.planned(path, {"d/CIK030.json"}, ".json", 1 << 40))
    read = []

    class File:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append((self.f.tell(), n))
            return self.f.read(n)

    with open(path, "rb") as f:
        assert json.loads(archives.unpacked(File(f), *part.ranges[0])) == docs["d/CIK030.json"]
    name, place, size, *_ = part.ranges[0]
    assert all(place <= at and at + n <= place + size + 200 for at, n in read)


def test_broken_and_empty(spark, archive, tmp_path):
    path, _ = archive
    member = next(archives.planned(path, {"d/CIK030.json"}, ".json", 1 << 40)).ranges[0]
    with open(path, "rb") as f, pytest.raises(ValueError, match="checksum"):
        archives.unpacked(f, *member[:5], member[5] ^ 1)
    zipfile.ZipFile(tmp_path / "e.zip", "w").close()
    assert readers.zipped_json(spark, str(tmp_path / "e.zip")).collect() == []
    assert {r.archive for r in readers.zipped_json(spark, str(tmp_path)).select("archive").distinct().collect()} == {f"{tmp_path}/a.zip"}
    assert not archives.supported("viewfs://store/x.zip")
