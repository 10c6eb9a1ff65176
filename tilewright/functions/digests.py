"""SHA-256 whose state another process can take up.

``hashlib`` does not give its state away.  The library behind it does: its
``SHA256_CTX`` is a plain structure, without pointers.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib


class _Context(ctypes.Structure):
    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("size", ctypes.c_uint)]


class Sha256:
    """As ``hashlib.sha256``; ``state`` is what the next one starts from."""

    def __init__(self, state: bytes | None = None) -> None:
        self._lib = _library()
        self._own = _Context() if state is None else _Context.from_buffer_copy(state)
        if state is None:
            self._lib.SHA256_Init(ctypes.byref(self._own))

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(ctypes.byref(self._own), data, len(data))

    def state(self) -> bytes:
        return bytes(self._own)

    def hexdigest(self) -> str:
        last, out = _Context.from_buffer_copy(self._own), ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, ctypes.byref(last))
        return out.raw.hex()


@functools.cache
def _library() -> ctypes.CDLL:
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)  # its symbols are those of the libcrypto that Python has loaded
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return lib


@functools.cache
def resumable() -> bool:
    """Whether this Python's library has the functions, and they agree with ``hashlib``."""
    try:
        a = Sha256()
        a.update(b"tile\0" * 99)
        b = Sha256(a.state())
        b.update(b"s" * 9)
        return b.hexdigest() == hashlib.sha256(b"tile\0" * 99 + b"s" * 9).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False
