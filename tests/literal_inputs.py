"""Small literal inputs for queries of operators that the driver's tables can't feed: sources, binaries, archives, manifests."""

from __future__ import annotations

import gzip
import io
import tarfile

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "pkg/__init__.py": "",
    "pkg/signer.py": "import os\nimport hashlib\n\ndef sign(data):\n    key = 1\n    return hashlib.sha256(data)\n    print('never')\n    x = 2\n",
    "pkg/cli.py": "from pkg.signer import sign\n\ndef _helper():\n    return 1\n\nif __name__ == '__main__':\n    for p in ['a']:\n        for q in open(p):\n            sign(q)\n",
    "pkg/busy.py": "def busy(a, b, c, d, e, f):\n    out = ''\n" + "".join(f"    if a == {i}:\n        b = {i}\n" for i in range(11)) + "    return b, c, d, e, f, out\n",
    "pkg/broken.py": "def (:\n",
    "web/app.js": "import { x } from './x';\nexport function go() { return 1; }\nconst unused = 2;\n",
}
LINES = ["cipher = AES_256 in GCM mode", "key_size=2048", "DES old, md5 and SHA1", "password = 'hunter2'", "ssl.PROTOCOL_TLSv1_2", "RSA with 1024 bits", "-----BEGIN CERTIFICATE-----", "f.key_size",
         "arn:aws:kms:eu-west-1:123456789012:key/abc", "https://v1.vault.azure.net/keys/k", "SIGN_KEY_ID = abc", "pkcs11:token=t;object=o?pin-value=1", "Thales nShield", "IconShield", "HSM_SLOT=3 HSM_PIN=1", "/usr/lib/libsofthsm2-pkcs11.so"]
MANIFESTS = {"a/requirements.txt": "cryptography==42.0\nflask>=2\n# note\n", "b/package.json": '{"dependencies": {"node-forge": "^1.0", "react": "18"}}', "c/go.mod": "module m\nrequire golang.org/x/crypto v0.1.0\n", "d/pom.xml": "<project><artifactId>bcprov</artifactId></project>"}

LOCKS = {
    "p/pyproject.toml": '[project]\ndependencies = ["bcrypt>=4", "flask"]\n[tool.poetry.dependencies]\npython = "^3"\npyopenssl = "^24"\n',
    "p/package-lock.json": '{"packages": {"": {"version": "1"}, "node_modules/elliptic": {"version": "6.5.4"}, "node_modules/a/node_modules/jose": {"version": "5.0.0"}}}',
    "p/cargo.toml": '[dependencies]\nring = "0.17"\nrustls = { version = "0.23" }\n',
    "p/cargo.lock": '[[package]]\nname = "p256"\nversion = "0.13.2"\n',
    "p/go.sum": "x\n", "p/poetry.lock": '[[package]]\nname = "certifi"\nversion = "2024.1"\n', "p/Gemfile": 'gem "bcrypt", version: "3.1"\n', "p/build.gradle": "implementation 'org.bouncycastle:bcprov:1.70'\n",
    "p/pom.xml": '<project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>conscrypt</artifactId><dependencies><dependency><artifactId>bcpkix</artifactId><version>1.7</version></dependency></dependencies></project>',
    "r/requirements.txt": "-r sub/more.txt\npasslib\n-c ../out.txt\n", "r/sub/more.txt": "-r deep.txt\nargon2-cffi==23.1 ; python_version > '3'\n", "r/sub/deep.txt": "-r more.txt\ncryptography\n", "out.txt": "pycrypto\n",
}
APP = {
    "main.py": "from core.sign import seal\nimport core.util\n\ndef main():\n    return seal(open('requirements.txt'))\n\nif __name__ == '__main__':\n    main()\n",
    "core/__init__.py": "", "core/sign.py": "from .util import pad\nimport util\n\nclass Signer:\n    pass\n\ndef seal(x):\n    return pad(x)\n",
    "core/util.py": "def pad(x):\n    return x\n", "core/old.py": "def _gone():\n    return 1\n",
    "web/api.py": "import core.sign\n\n@app.get('/keys')\ndef keys():\n    return 1\n\n@router.post(\"/sign\")\ndef sign_it():\n    return 2\n",
    "tests/test_sign.py": "from core.sign import seal\n\ndef test_seal():\n    assert seal('util') == 'see _old'\n",
    "requirements.txt": "cryptography\n", "setup.cfg": "[x]\n",
}
SCRIPT = "const fs = require('fs');\nfetch('/x'); JSON.parse(y)\n"
TARGETS = [("https://a.example", None, "TLSv1.2", "sha256", "RSA", 2048, None), ("https://b.example", ["k1", "zz"], "TLSv1.3", "", "EC", None, None), ("http://c.example", ["k2"], None, None, None, None, None),
           ("https://d.example", ["p1"], None, None, None, None, "TimeoutError"), ("https://e.example", ["none"], "TLSv1.3", "x", "ECDSA", 256, None)]
CLAIMS = [("k1", "RSA", "key", "direct", 2048), ("k2", "RSA", "certificate", "certificate metadata", 1024), ("p1", "TLS1.2", "protocol", "direct", None), ("p2", "TLS1.0", "protocol", "direct", None), ("k3", "RSA", "key", "direct", None),
          ("c1", "ECDSA", "certificate", "certificate metadata", 256), ("h1", "SHA-256", "hash", "direct", None), ("h2", "MD5", "hash", "direct", None), ("d1", "bcrypt", "dependency", "dependency reference", None), ("l1", "SHA-2", "dependency", "dependency integrity metadata", None)]
SEEN = [(1, "probe a", "SHA-384"), (2, "probe b", "SHA-256"), (3, "probe c", "bcrypt")]
URLS = ["https://localhost/x", "http://127.0.0.9:8080/", "https://[::1]:8443/a", "https://Allowed.example./p", "https://other.example/", "ftp://localhost/", "https://u:p@localhost/", "https://localhost:0/", "https://localhost:99999/", "https://localhost:x/", "https://", "", "https://127.0.0.1 /", "https://a\tb/"]

#: A self-signed certificate made for this purpose.
CERTIFICATE = """-----BEGIN CERTIFICATE-----
MIIBbTCCAROgAwIBAgIUdjQSv1inpo+q5AmtPYlFvIQg0N0wCgYIKoZIzj0EAwIw
DDEKMAgGA1UEAwwBdDAeFw0yNjExMjYxNTE0MzNaFw0yNjEyMjYxNTE0MzNaMAwx
CjAIBgNVBAMMAXQwWTATBgcqhkjOPQIBBggqhkjOPQMBBwNCAAQEiz4TZuD6rzAf
Ihg/mrr1YosgOA8rbEd2G9tEXDJn0IikeJAArpkN+o9XocKHemwbO5c+3UgB9uLk
4tu+lUh1o1MwUTAdBgNVHQ4EFgQUvgok/+W7v85fYshfFVpmxIBp7XswHwYDVR0j
BBgwFoAUvgok/+W7v85fYshfFVpmxIBp7XswDwYDVR0TAQH/BAUwAwEB/zAKBggq
hkjOPQQDAgNIADBFAiBusBuA++tzL+IAFeXlqZcee5WYaHpwK95OPsL8qOaoewIh
AO8/4yO3VMza44+KcP0cMIGF7oGl5j5vXKlLeYrBF7S4
-----END CERTIFICATE-----
"""
NOTES = {"n/a.md": "owner = x\nowner = y\nsee [[n/b]] and [[n/b]]", "n/b.md": "no pairs"}
CONFIG = '{"config": {"Env": ["PATH=/bin", "DB_PASSWORD=hunter2", "API_KEY=k"]}}'
ADDRESSES = ["https://github.com/owner/name", "https://github.com/owner/name.git", "https://github.com/owner/name/tree/main", "http://github.com/owner/name", "https://user@github.com/owner/name", "https://github.com/owner/..", "https://example.com/owner/name"]


def table(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows.items()), "path string, text string")


def binaries(spark: SparkSession) -> DataFrame:
    body = b"\x7fELF\0\0libcrypto.so.3\0EVP_EncryptInit\0AES-256\0RSA 2048\0EVP_EncryptInit\0noise\0TLSv1.2\0"
    return spark.createDataFrame([("bin/x", bytearray(body), len(body)), ("bin/text", bytearray(b"libcrypto AES-256"), 17)], "path string, content binary, length long")


def archives(spark: SparkSession) -> DataFrame:
    def tar(members: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    layer = tar({"etc/ssl/app.conf": b"cipher=RC4\n", "../evil.key": b"MD5", "etc/motd": b"DES and 3DES\n"})
    upper = tar({"srv/requirements.txt": b"hashlib SHA256\n", "bin/tool": b"\x7fELF\0\0AES-256\0EVP_EncryptInit\0", "etc/tls.bin": b"\0\0RC4"})
    image = tar({"b/layer.tar": upper, "a/layer.tar": layer, "unlisted.tar": layer, "c.json": CONFIG.encode(), "manifest.json": b'[{"Config": "c.json", "Layers": ["a/layer.tar", "b/layer.tar", "/x"]}]'})
    rows = [("img.tar", image), ("layer.tgz", gzip.compress(layer)), ("bad.tar", b"no archive"), ("cut.tar", layer[:1200]), ("Dockerfile", b"FROM x\nENV CIPHER=RC4\n")]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def tree(spark: SparkSession) -> DataFrame:
    """Files of a small project, as a scan reads them."""
    body = {**{k: v.encode() for k, v in SOURCES.items()}, **{f"m/{k}": v.encode() for k, v in MANIFESTS.items()}, "conf/app.tf": "\n".join(LINES).encode(), "conf/c.pem": CERTIFICATE.encode(),
            "bin/x": b"\x7fELF\0\0libcrypto.so.3\0AES-256\0", "data/raw.bin": b"\0\1MD5"}
    rows = [(k, bytearray(v), len(v)) for k, v in body.items()] + [(r.path, r.content, len(r.content)) for r in archives(spark).collect()]
    return spark.createDataFrame(rows, "path string, content binary, length long")
