"""Rows that scans of the literal inputs give, read through against the rules: {name: (columns, rows)}."""

EXPECTED = {
    "line_findings": ({"line": "int", "algorithm": "string", "category": "string", "key_size": "int", "mode": "string", "protocol_version": "string", "library": "string", "usage": "string", "evidence": "string"}, [
        (1, 'AES-256', 'symmetric', 256, 'GCM', '', '', 'direct', 'cipher = AES_256 in GCM mode'),
        (2, 'KEYSIZE', 'key', 2048, '', '', '', 'key size declaration', 'key_size=2048'),
        (3, 'DES', 'symmetric', None, '', '', '', 'direct', 'DES old, md5 and SHA1'),
        (3, 'MD5', 'hash', None, '', '', '', 'direct', 'DES old, md5 and SHA1'),
        (3, 'SHA-1', 'hash', None, '', '', '', 'direct', 'DES old, md5 and SHA1'),
        (5, 'TLS1.2', 'protocol', None, '', 'TLS1.2', '', 'direct', 'ssl.PROTOCOL_TLSv1_2'),
        (6, 'RSA', 'asymmetric', 1024, '', '', '', 'direct', 'RSA with 1024 bits'),
        (7, 'PEM-CERTIFICATE', 'certificate', None, '', '', '', 'direct', '-----BEGIN CERTIFICATE-----'),
    ]),
    "cloud_hsm_findings": ({"scanner": "string", "line": "int", "algorithm": "string", "category": "string", "library": "string", "confidence": "double", "evidence": "string"}, [
        ('cloud', 10, 'KEYVAULT', 'key', 'azure:keyvault', 0.85, 'https://v1.vault.azure.net/keys/k'),
        ('cloud', 11, 'KMS', 'key', 'config-reference', 0.55, 'SIGN_KEY_ID = [REDACTED]'),
        ('cloud', 15, 'KMS', 'key', 'config-reference', 0.55, 'HSM_SLOT = [REDACTED]'),
        ('cloud', 9, 'KMS', 'key', 'aws:kms', 0.85, 'arn:aws:kms:eu-west-1:****:key/abc'),
        ('hsm', 12, 'PKCS11', 'key', 'PKCS#11 URI', 0.85, 'pkcs11:token=t;[ATTRIBUTES-REDACTED]?[QUERY-REDACTED]'),
        ('hsm', 13, 'HSM', 'library', 'nShield', 0.6, 'Thales nShield'),
        ('hsm', 15, 'HSM', 'key', 'HSM_PIN', 0.55, 'HSM_SLOT=3 HSM_PIN=1'),
        ('hsm', 15, 'HSM', 'key', 'HSM_SLOT', 0.55, 'HSM_SLOT=3 HSM_PIN=1'),
        ('hsm', 16, 'PKCS11', 'library', '/usr/lib/libsofthsm2-pkcs11.so', 0.8, '/usr/lib/libsofthsm2-pkcs11.so'),
    ]),
    "package_findings": ({"scanner": "string", "file_path": "string", "line": "int", "algorithm": "string", "category": "string", "library": "string", "confidence": "double", "usage": "string", "version": "string"}, [
        ('dependency', 'a/requirements.txt', 0, 'PyCA cryptography', 'dependency', 'cryptography', 0.8, 'dependency reference', '==42.0'),
        ('dependency', 'b/package.json', 0, 'node-forge', 'dependency', 'node-forge', 0.8, 'dependency reference', '^1.0'),
        ('dependency', 'c/go.mod', 0, 'x/crypto', 'dependency', 'golang.org/x/crypto', 0.8, 'dependency reference', 'v0.1.0'),
    ]),
    "binary_findings": ({"file_path": "string", "place": "int", "algorithm": "string", "category": "string", "key_size": "int", "usage": "string", "evidence": "string"}, [
        ('bin/x', 0, 'OpenSSL', 'library', None, 'binary library reference', 'libcrypto.so.3'),
        ('bin/x', 1, 'OpenSSL', 'library', None, 'binary symbol reference', 'EVP_EncryptInit'),
        ('bin/x', 2, 'AES-256', 'symmetric', 256, 'binary string reference', 'AES-256'),
        ('bin/x', 3, 'RSA', 'asymmetric', 2048, 'binary string reference', 'RSA 2048'),
        ('bin/x', 6, 'TLS', 'protocol', None, 'binary string reference', 'TLSv1.2'),
    ]),
    "archive_members": ({"path": "string", "member": "string", "n_bytes": "bigint"}, [
        ('cut.tar', 'etc/ssl/app.conf', 11),
        ('img.tar', 'a/layer.tar>etc/motd', 13),
        ('img.tar', 'a/layer.tar>etc/ssl/app.conf', 11),
        ('img.tar', 'b/layer.tar>bin/tool', 30),
        ('img.tar', 'b/layer.tar>etc/tls.bin', 5),
        ('img.tar', 'b/layer.tar>srv/requirements.txt', 15),
        ('layer.tgz', 'etc/motd', 13),
        ('layer.tgz', 'etc/ssl/app.conf', 11),
    ]),
    "archive_findings": ({"file_path": "string", "line": "int", "algorithm": "string", "category": "string", "usage": "string", "evidence": "string"}, [
        ('Dockerfile', 2, 'RC4', 'symmetric', 'container file reference', 'ENV CIPHER=RC4'),
        ('cut.tar>etc/ssl/app.conf', 1, 'RC4', 'symmetric', 'container file reference', 'cipher=RC4'),
        ('img.tar>a/layer.tar>etc/ssl/app.conf', 1, 'RC4', 'symmetric', 'container file reference', 'cipher=RC4'),
        ('img.tar>b/layer.tar>bin/tool', 0, 'AES-256', 'symmetric', 'container binary reference', 'AES-256'),
        ('img.tar>b/layer.tar>bin/tool', 0, 'OpenSSL', 'library', 'container binary reference', 'EVP_EncryptInit'),
        ('img.tar>b/layer.tar>srv/requirements.txt', 1, 'SHA-2', 'hash', 'container file reference', 'hashlib SHA256'),
        ('img.tar>b/layer.tar>srv/requirements.txt', 1, 'STDLIB', 'library', 'container file reference', 'hashlib SHA256'),
        ('img.tar>config', 0, 'ENV-SECRET', 'key', 'container config reference', 'ENV DB_PASSWORD present in image config (value withheld)'),
        ('layer.tgz>etc/ssl/app.conf', 1, 'RC4', 'symmetric', 'container file reference', 'cipher=RC4'),
    ]),
    "scan": ({"scanner": "string", "file_path": "string", "line": "int", "algorithm": "string", "category": "string", "key_size": "int", "severity": "string", "priority": "string"}, [
        ('binary', 'bin/x', 0, 'AES-256', 'symmetric', 256, 'low', 'P3'),
        ('binary', 'bin/x', 0, 'OpenSSL', 'library', None, 'medium', 'P3'),
        ('cloud', 'conf/app.tf', 10, 'KEYVAULT', 'key', None, 'medium', 'P3'),
        ('cloud', 'conf/app.tf', 11, 'KMS', 'key', None, 'medium', 'P3'),
        ('cloud', 'conf/app.tf', 15, 'KMS', 'key', None, 'medium', 'P3'),
        ('cloud', 'conf/app.tf', 9, 'KMS', 'key', None, 'medium', 'P3'),
        ('container', 'Dockerfile', 2, 'RC4', 'symmetric', None, 'high', 'P0'),
        ('container', 'cut.tar>etc/ssl/app.conf', 1, 'RC4', 'symmetric', None, 'high', 'P0'),
        ('container', 'img.tar>a/layer.tar>etc/ssl/app.conf', 1, 'RC4', 'symmetric', None, 'high', 'P0'),
        ('container', 'img.tar>b/layer.tar>bin/tool', 0, 'AES-256', 'symmetric', 256, 'low', 'P3'),
        ('container', 'img.tar>b/layer.tar>bin/tool', 0, 'OpenSSL', 'library', None, 'medium', 'P3'),
        ('container', 'img.tar>b/layer.tar>srv/requirements.txt', 1, 'SHA-2', 'hash', None, 'low', 'P3'),
        ('container', 'img.tar>b/layer.tar>srv/requirements.txt', 1, 'STDLIB', 'library', None, 'low', 'P3'),
        ('container', 'img.tar>config', 0, 'ENV-SECRET', 'key', None, 'medium', 'P3'),
        ('container', 'layer.tgz>etc/ssl/app.conf', 1, 'RC4', 'symmetric', None, 'high', 'P0'),
        ('dependency', 'm/a/requirements.txt', 0, 'PyCA cryptography', 'dependency', None, 'medium', 'P3'),
        ('dependency', 'm/b/package.json', 0, 'node-forge', 'dependency', None, 'medium', 'P3'),
        ('dependency', 'm/c/go.mod', 0, 'x/crypto', 'dependency', None, 'medium', 'P3'),
        ('hsm', 'conf/app.tf', 12, 'PKCS11', 'key', None, 'medium', 'P3'),
        ('hsm', 'conf/app.tf', 13, 'HSM', 'library', None, 'medium', 'P3'),
        ('hsm', 'conf/app.tf', 15, 'HSM', 'key', None, 'medium', 'P3'),
        ('hsm', 'conf/app.tf', 15, 'HSM', 'key', None, 'medium', 'P3'),
        ('hsm', 'conf/app.tf', 16, 'PKCS11', 'library', None, 'medium', 'P3'),
        ('source', 'Dockerfile', 2, 'RC4', 'symmetric', None, 'high', 'P0'),
        ('source', 'conf/app.tf', 1, 'AES-256', 'symmetric', 256, 'low', 'P3'),
        ('source', 'conf/app.tf', 2, 'KEYSIZE', 'key', 2048, 'medium', 'P3'),
        ('source', 'conf/app.tf', 3, 'DES', 'symmetric', None, 'high', 'P0'),
        ('source', 'conf/app.tf', 3, 'MD5', 'hash', None, 'high', 'P0'),
        ('source', 'conf/app.tf', 3, 'SHA-1', 'hash', None, 'high', 'P0'),
        ('source', 'conf/app.tf', 5, 'TLS1.2', 'protocol', None, 'medium', 'P3'),
        ('source', 'conf/app.tf', 6, 'RSA', 'asymmetric', 1024, 'critical', 'P0'),
        ('source', 'conf/app.tf', 7, 'PEM-CERTIFICATE', 'certificate', None, 'medium', 'P3'),
        ('source', 'conf/c.pem', 0, 'ECDSA', 'certificate', None, 'critical', 'P1'),
        ('source', 'conf/c.pem', 1, 'PEM-CERTIFICATE', 'certificate', None, 'medium', 'P3'),
        ('source', 'm/a/requirements.txt', 1, 'PyCA cryptography', 'dependency', None, 'medium', 'P3'),
        ('source', 'm/b/package.json', 1, 'node-forge', 'dependency', None, 'medium', 'P3'),
        ('source', 'm/d/pom.xml', 1, 'Bouncy Castle', 'dependency', None, 'medium', 'P3'),
        ('source', 'pkg/signer.py', 2, 'STDLIB', 'library', None, 'low', 'P3'),
        ('source', 'pkg/signer.py', 6, 'SHA-2', 'hash', None, 'low', 'P3'),
        ('source', 'pkg/signer.py', 6, 'STDLIB', 'library', None, 'low', 'P3'),
    ]),
    "scan_counts": ({"scanner": "string", "family": "string", "n": "bigint"}, [
        ('binary', 'AES', 1),
        ('binary', 'OPENSSL', 1),
        ('cloud', 'KEYVAULT', 1),
        ('cloud', 'KMS', 3),
        ('container', 'AES', 1),
        ('container', 'ENV-SECRET', 1),
        ('container', 'OPENSSL', 1),
        ('container', 'RC4', 4),
        ('container', 'SHA-2', 1),
        ('container', 'STDLIB', 1),
        ('dependency', 'NODE-FORGE', 1),
        ('dependency', 'PYCA CRYPTOGRAPHY', 1),
        ('dependency', 'X/CRYPTO', 1),
        ('hsm', 'HSM', 3),
        ('hsm', 'PKCS11', 2),
        ('source', 'AES', 1),
        ('source', 'BOUNCY CASTLE', 1),
        ('source', 'DES', 1),
        ('source', 'ECDSA', 1),
        ('source', 'KEYSIZE', 1),
        ('source', 'MD5', 1),
        ('source', 'NODE-FORGE', 1),
        ('source', 'PEM', 2),
        ('source', 'PYCA CRYPTOGRAPHY', 1),
        ('source', 'RC4', 1),
        ('source', 'RSA', 1),
        ('source', 'SHA-1', 1),
        ('source', 'SHA-2', 1),
        ('source', 'STDLIB', 2),
        ('source', 'TLS', 1),
    ]),
    "locked_packages": ({"path": "string", "name": "string", "version": "string"}, [
        ('p/Gemfile', 'bcrypt', '3.1'),
        ('p/build.gradle', 'bcprov', '1.70'),
        ('p/cargo.lock', 'p256', '0.13.2'),
        ('p/cargo.toml', 'ring', '0.17'),
        ('p/cargo.toml', 'rustls', '0.23'),
        ('p/package-lock.json', 'elliptic', '6.5.4'),
        ('p/package-lock.json', 'jose', '5.0.0'),
        ('p/poetry.lock', 'certifi', ''),
        ('p/pom.xml', 'bcpkix', '1.7'),
        ('p/pyproject.toml', 'bcrypt', '>=4'),
        ('p/pyproject.toml', 'flask', ''),
        ('p/pyproject.toml', 'pyopenssl', '^24'),
        ('r/requirements.txt', 'argon2-cffi', '==23.1'),
        ('r/requirements.txt', 'cryptography', ''),
        ('r/requirements.txt', 'passlib', ''),
    ]),
    "locked_findings": ({"file_path": "string", "algorithm": "string", "library": "string", "confidence": "double", "version": "string"}, [
        ('p/Gemfile', 'bcrypt', 'bcrypt', 0.8, '3.1'),
        ('p/build.gradle', 'Bouncy Castle', 'bcprov', 0.8, '1.70'),
        ('p/cargo.lock', 'ECC', 'p256', 0.75, '0.13.2'),
        ('p/cargo.toml', 'ring', 'ring', 0.8, '0.17'),
        ('p/cargo.toml', 'rustls', 'rustls', 0.8, '0.23'),
        ('p/package-lock.json', 'JOSE', 'jose', 0.8, '5.0.0'),
        ('p/package-lock.json', 'elliptic', 'elliptic', 0.7, '6.5.4'),
        ('p/poetry.lock', 'certifi CA bundle', 'certifi', 0.6, ''),
        ('p/pom.xml', 'Bouncy Castle', 'bcpkix', 0.8, '1.7'),
        ('p/pyproject.toml', 'PyOpenSSL', 'pyopenssl', 0.8, '^24'),
        ('p/pyproject.toml', 'bcrypt', 'bcrypt', 0.8, '>=4'),
        ('r/requirements.txt', 'PyCA cryptography', 'cryptography', 0.8, ''),
        ('r/requirements.txt', 'argon2-cffi', 'argon2-cffi', 0.8, '==23.1'),
        ('r/requirements.txt', 'passlib', 'passlib', 0.75, ''),
    ]),
    "certificates": ({"path": "string", "algorithm": "string", "key_size": "int", "curve": "string", "signature_algorithm": "string", "expires_at": "string"}, [
        ('c.pem', 'ECDSA', None, 'P-256', 'ECDSA-SHA-256', '2026-12-26T15:14:33+00:00'),
    ]),
}
