"""Logging to standard error, plain or as JSON."""

from __future__ import annotations

import json
import logging
import sys


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()})


def configure(level: str = "info", as_json: bool = False) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    root = logging.getLogger("gleanery")
    root.handlers[:] = [handler]
    root.setLevel(level.upper())
