"""SHA-256 whose state is handed on from one task to the next."""

from __future__ import annotations

import ctypes
import ctypes.util

#: Bytes of a state in OpenSSL.
STATE = 112


def _library() -> ctypes.CDLL:
    name = ctypes.util.find_library("crypto")
    if name is None:
        raise OSError("no OpenSSL library, whose SHA-256 can be stopped and gone on with")
    return ctypes.CDLL(name)


class Sha256:
    """As hashlib.sha256, which can't be pickled; ``state`` is what was hashed so far, to go on from elsewhere."""

    def __init__(self, state: bytes | None = None) -> None:
        self._crypto, self._held = _library(), ctypes.create_string_buffer(state, STATE) if state else ctypes.create_string_buffer(STATE)
        if not state:
            self._crypto.SHA256_Init(self._held)

    def update(self, address: int, size: int) -> None:
        """Takes size bytes of memory at an address."""
        self._crypto.SHA256_Update(self._held, ctypes.c_void_p(address), ctypes.c_size_t(size))

    @property
    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        end, out = ctypes.create_string_buffer(self.state, STATE), ctypes.create_string_buffer(32)
        self._crypto.SHA256_Final(out, end)
        return out.raw.hex()
