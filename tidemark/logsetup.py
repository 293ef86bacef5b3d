"""Logging of events on the driver: a line has time, level and the event as JSON."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path


def setup_logging(file: str | None = None, name: str = "tidemark") -> logging.Logger:
    """A logger that writes to standard output, and to ``file`` if one is named; handlers of an earlier call go."""
    logger = logging.getLogger(name)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(file))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
        logger.addHandler(h)
    logger.setLevel(logging.INFO)
    logger.propagate = False
    return logger


def log_event(logger: logging.Logger, level: int, **event: object) -> None:
    logger.log(level, json.dumps(event))
