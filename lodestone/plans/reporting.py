"""What a long-running index says about itself: its identity, throttled progress and a log of bounded size."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import time
from collections.abc import Callable
from logging.handlers import RotatingFileHandler

#: Bytes of a log file and old ones that are kept; seconds between progress lines on a terminal and elsewhere.
LOG_BYTES, LOG_FILES = 2 * 1024 * 1024, 5
TERMINAL_SECONDS, OTHER_SECONDS = 1.0, 5.0


def instance_hash(folder: str) -> str:
    """Names the index that lies in a folder, whatever way leads to it."""
    return hashlib.sha256(os.path.realpath(folder).encode()).hexdigest()


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created))
        return json.dumps({"at": f"{at}.{int(record.msecs):03d}Z", "level": record.levelname.lower(), "message": record.getMessage()}, ensure_ascii=False)


def rotating_log(path: str, name: str = "lodestone", *, size: int = LOG_BYTES, files: int = LOG_FILES) -> logging.Logger:
    """A logger of one JSON object a line; a file that would pass ``size`` is put aside, and ``files`` files are kept in all."""
    logger = logging.getLogger(f"{name}:{os.path.realpath(path)}")
    if not logger.handlers:
        handler = RotatingFileHandler(path, maxBytes=size, backupCount=files - 1, encoding="utf-8")
        handler.setFormatter(_Lines())
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger


class Progress:
    """Passes on at most one report in ``every`` seconds, but each new phase at once; to be given to Index.sync as ``progress``."""

    def __init__(self, write: Callable[[str], None], *, terminal: bool = False, clock: Callable[[], float] = time.monotonic):
        self.write, self.every, self.clock = write, TERMINAL_SECONDS if terminal else OTHER_SECONDS, clock
        self.phase: str | None = None
        self.at = float("-inf")

    def __call__(self, phase: str, numbers: dict) -> None:
        now = self.clock()
        if phase == self.phase and now - self.at < self.every:
            return
        self.phase, self.at = phase, now
        self.write(f"{phase}: " + ", ".join(f"{k} {v}" for k, v in numbers.items() if isinstance(v, int)))
