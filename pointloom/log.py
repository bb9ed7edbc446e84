"""A logger to the console and, if asked, a file."""

from __future__ import annotations

import logging


def create_logger(name: str = "pointloom", path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not logger.handlers:
        form = logging.Formatter("%(asctime)s %(levelname)5s %(message)s")
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
            handler.setFormatter(form)
            logger.addHandler(handler)
    return logger
