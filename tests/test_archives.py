"""Archives: members by ranges, damaged and unsafe ones found, extraction all or nothing."""

import hashlib
import os
import random
import stat
import zipfile

import pytest

from fluxgrid.sources import archives as A


def archive(path, members, links=()):
    with zipfile.ZipFile(path, "w", compression=zipfile.ZIP_DEFLATED) as z:
        for k, (name, data) in enumerate(members.items()):
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_STORED if k % 3 == 0 else zipfile.ZIP_DEFLATED
            if name in links:
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, data)
    return str(path)


@pytest.fixture
def members():
    draw = random.Random(2)
    return {f"deliverables/{'sub/' if k % 4 == 0 else ''}f{k:02d}.bin": bytes(draw.randrange(4) for _ in range(draw.choice([0, 10, 50_000]))) for k in range(40)}


def test_members_are_read_by_ranges(spark, tmp_path, members):
    path = archive(tmp_path / "a.zip", members | {"deliverables/big.bin": b"ab" * 3_000_000, "empty/": b""})
    table = A.read_zip(spark, path, content=60_000, range_bytes=10_000)
    assert table.rdd.getNumPartitions() > 8
    got = {r.name: r for r in table.collect()}
    assert {n: r.content for n, r in got.items() if n in members} == members and all(r.crc_ok for r in got.values())
    assert {n: r.sha256 for n, r in got.items() if n in members} == {n: hashlib.sha256(d).hexdigest() for n, d in members.items()}
    assert got["deliverables/big.bin"].content is None and got["deliverables/big.bin"].sha256 == hashlib.sha256(b"ab" * 3_000_000).hexdigest() and got["empty/"].is_folder


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_a_changed_byte_is_found(spark, tmp_path, method):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", compression=method) as z:
        for k in range(5):
            z.writestr(f"m{k}", os.urandom(4_000))
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("m3").header_offset + 1_000
    raw = bytearray(path.read_bytes())
    raw[at] ^= 0x40
    path.write_bytes(raw)
    assert {r.name: r.crc_ok for r in A.read_zip(spark, str(path)).collect()} == {f"m{k}": k != 3 for k in range(5)}
    assert [tuple(r) for r in A.member_problems(A.read_zip(spark, str(path)), ["m1", "gone"]).orderBy("name").collect()] == [("gone", "missing"), ("m3", "corrupt ZIP member")]


def test_extraction(spark, tmp_path, members):
    path, out = archive(tmp_path / "a.zip", members | {"readme": b"outside"}), tmp_path / "out"
    assert A.extract(spark, path, str(out), ["deliverables/f01.bin"], "deliverables", {"receipt.json": "{}"}) == {"members": 41, "bytes": sum(map(len, members.values())) + 7}
    got = {os.path.relpath(os.path.join(d, f), out): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(out) for f in names}
    assert got == {n.removeprefix("deliverables/"): d for n, d in members.items()} | {"receipt.json": b"{}"}
    with pytest.raises(Exception, match="refusing to overwrite"):
        A.extract(spark, path, str(out), [], "deliverables")


@pytest.mark.parametrize(("more", "links", "fault"), [({"../escape.txt": b"bad"}, (), "unsafe ZIP path: ../escape.txt"), ({"/abs": b""}, (), "unsafe ZIP path: /abs"), ({"link": b"/etc/passwd"}, ("link",), "symbolic link: link"), ({}, (), "missing: deliverables/latest.pt")])
def test_a_bad_archive_leaves_nothing(spark, tmp_path, members, more, links, fault):
    path = archive(tmp_path / "a.zip", members | more, links)
    with pytest.raises(ValueError, match=fault):
        A.extract(spark, path, str(tmp_path / "out"), ["deliverables/f01.bin", *([] if more else ["deliverables/latest.pt"])])
    assert sorted(os.listdir(tmp_path)) == ["a.zip"]
