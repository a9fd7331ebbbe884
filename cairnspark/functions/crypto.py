"""Client-side sealing of payloads and vectors, and distance-preserving encryption.

Payloads and vectors are sealed with Spark's AES-GCM, bound to an associated
text.  The distance-preserving form (normalise, permute by key, scale, add noise
from a ball) keeps l2 order up to the noise and carries an HMAC tag.
"""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEALED = "_sealed"


class TagError(ValueError):
    """A tag does not match its vector."""


def seal(plain: Column, key: bytes, aad: str = "") -> Column:
    """AES-GCM envelope of a string column: JSON with version, algorithm and ciphertext."""
    ct = F.base64(F.aes_encrypt(plain, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad.encode())))
    return F.when(plain.isNotNull(), F.to_json(F.struct(F.struct(F.lit(1).alias("v"), F.lit("AES-GCM").alias("alg"), ct.alias("ct")).alias(SEALED))))


def open_sealed(envelope: Column, key: bytes, aad: str = "") -> Column:
    ct = F.get_json_object(envelope, f"$.{SEALED}.ct")
    return F.aes_decrypt(F.unbase64(ct), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad.encode())).cast("string")


def is_sealed(envelope: Column) -> Column:
    return F.coalesce(F.get_json_object(envelope, f"$.{SEALED}").isNotNull(), F.lit(False))


def seal_vector(v: Column, key: bytes, aad: str = "") -> Column:
    """Sealed vector: its components as JSON text."""
    return seal(F.to_json(v.cast("array<float>")), key, aad)


def open_vector(envelope: Column, key: bytes, dim: int, aad: str = "") -> Column:
    v = F.from_json(open_sealed(envelope, key, aad), "array<float>")
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"sealed vector has not {dim} components")))


def _stream(key: bytes, label: bytes, n: int) -> np.ndarray:
    """n uniform doubles in [0, 1) from a keyed SHA-256 counter stream."""
    raw = b"".join(hashlib.sha256(key + label + i.to_bytes(8, "little")).digest() for i in range(-(-8 * n // 32)))
    return (np.frombuffer(raw[: 8 * n], "<u8") >> np.uint64(11)).astype(float) * 2.0**-53


class DistancePreserving:
    """Keyed transform v -> scale * permute(v) + noise with |noise| <= scale * beta / 4."""

    def __init__(self, key: bytes, dim: int, scale: float = 1.0, beta: float = 0.0, normalize: bool = False):
        self.key, self.dim, self.scale, self.beta, self.normalize = key, dim, scale, beta, normalize
        self.order = np.argsort(_stream(key, b"order", dim), kind="stable")

    def _noise(self, nonce: bytes) -> np.ndarray:
        if not self.beta:
            return np.zeros(self.dim)
        u = _stream(self.key, b"noise" + nonce, 2 * self.dim + 2)
        gauss = np.sqrt(-2 * np.log1p(-u[: self.dim])) * np.cos(2 * np.pi * u[self.dim : 2 * self.dim])
        radius = self.scale * self.beta / 4 * u[-1] ** (1 / self.dim)
        return gauss / (np.linalg.norm(gauss) or 1.0) * radius

    def encrypt(self, v, nonce: bytes, tagged: bool = True) -> tuple[np.ndarray, bytes | None]:
        v = np.asarray(v, float)
        if v.shape != (self.dim,):
            raise ValueError(f"vector has not {self.dim} components")
        if self.normalize and (n := np.linalg.norm(v)):
            v = v / n
        out = (self.scale * v[self.order] + self._noise(nonce)).astype("<f8")
        return out, self._tag(out, nonce) if tagged else None

    def _tag(self, out: np.ndarray, nonce: bytes) -> bytes:
        return hmac.new(self.key, nonce + out.tobytes(), hashlib.sha256).digest()

    def decrypt(self, out, nonce: bytes, tag: bytes) -> np.ndarray:
        out = np.asarray(out, "<f8")
        if not hmac.compare_digest(tag, self._tag(out, nonce)):
            raise TagError("tag does not match")
        v = np.empty(self.dim)
        v[self.order] = (out - self._noise(nonce)) / self.scale
        return v

    def encrypt_column(self, v: Column, nonce: Column) -> Column:
        """Encrypted vectors (array<double>); the nonce is a string column."""
        import pandas as pd

        def run(vs, ns):
            return pd.Series([None if x is None else self.encrypt(x, n.encode(), False)[0].tolist() for x, n in zip(vs, ns)])

        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(v, nonce)

    def decrypt_column(self, out: Column, nonce: Column, tag: Column) -> Column:
        """Vectors (array<double>) of encrypted ones whose tag matches; another tag is an error."""
        import pandas as pd

        def run(xs, ns, ts):
            return pd.Series([None if x is None else self.decrypt(x, n.encode(), bytes(t)).tolist() for x, n, t in zip(xs, ns, ts)])

        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(out, nonce, tag)

    def tag_column(self, out: Column, nonce: Column) -> Column:
        import pandas as pd

        def run(xs, ns):
            return pd.Series([None if x is None else self._tag(np.asarray(x, "<f8"), n.encode()) for x, n in zip(xs, ns)])

        return F.pandas_udf(run, T.BinaryType())(out, nonce)


class Keyring:
    """A data key for each collection, wrapped by a root key and stored as a file of its own.

    Deleting a collection's file makes everything sealed with its key unreadable, backups too.
    """

    def __init__(self, spark, root: str, root_key: bytes):
        from ..plans.table import Files

        if len(root_key) not in (16, 24, 32):
            raise ValueError("the root key has 16, 24 or 32 bytes")
        self.spark, self.files, self.root_key = spark, Files(spark, root), root_key

    def _one(self, column: Column):
        return self.spark.range(1).select(column.alias("x")).first()["x"]

    def create(self, name: str) -> bytes:
        """A new key for ``name``, which must have none."""
        import secrets

        key = secrets.token_bytes(32)
        sealed = self._one(F.base64(F.aes_encrypt(F.lit(key), F.lit(self.root_key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(name.encode()))))
        self.files.create(f"{name}.key", sealed)
        return key

    def key(self, name: str) -> bytes:
        """The key of ``name``; KeyError if it was never made or has been shredded."""
        if not self.files.exists(f"{name}.key"):
            raise KeyError(name)
        sealed = self.files.read(f"{name}.key")
        return bytes(self._one(F.aes_decrypt(F.unbase64(F.lit(sealed)), F.lit(self.root_key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(name.encode()))))

    def shred(self, name: str) -> bool:
        return self.files.exists(f"{name}.key") and self.files.delete(f"{name}.key")
