"""Archives meet Python one at a time, not in batches of ten thousand rows."""

import io
import tarfile

from siltstone.sources import images


def _tar(**named):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, body in named.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_members_are_streamed(spark):
    whole = _tar(a=b"1", b=b"")
    found = images.members_of(spark.createDataFrame([("x.tar", bytearray(whole)), ("broken", bytearray(b"no tar")), ("cut.tar", bytearray(whole[:1030]))], "path string, content binary"))
    assert {(r.image, r.member, bytes(r.content)) for r in found.collect()} == {("x.tar", "a", b"1"), ("x.tar", "b", b""), ("cut.tar", "a", b"1")}
    layers = spark.createDataFrame([("x", 0, "l", bytearray(whole))], "image string, no int, layer string, content binary")
    members = images.layer_members(layers)
    assert {(r.image, r.no, r.member, bytes(r.content)) for r in members.collect()} == {("x", 0, "a", b"1"), ("x", 0, "b", b"")}
    for df in (found, members):
        assert "MapInPandas" not in df._jdf.queryExecution().toString()
