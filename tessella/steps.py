"""Log records of a verb's steps: enter, done with its time, failed."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

LOG = logging.getLogger("tessella")


@contextmanager
def step(verb: str, name: str, **facts) -> Iterator[None]:
    """Logs what is done within, at INFO."""
    said = " ".join(f"{k}={v}" for k, v in facts.items())
    LOG.info("%s %s enter %s", verb, name, said)
    began = time.perf_counter()
    try:
        yield
    except Exception:
        LOG.warning("%s %s failed after %.1f s", verb, name, time.perf_counter() - began)
        raise
    LOG.info("%s %s done in %.1f s", verb, name, time.perf_counter() - began)
