"""A scan service on lines of JSON.

Commands: ``{"cmd": "scan", "path": ..., "config": {...}}``, ``cancel``,
``shutdown``. Settings are flat keys (``sampling_rate``, ``exclude``,
``show_pii_samples``, ``pii_min_confidence``, ``simhash_threshold``,
``simhash_bits``) or the sections of a config file. Events: ready, phase, progress, complete (with the report),
cancelled, error. A new scan cancels the one that runs.
"""

from __future__ import annotations

import json
import os
import threading
from typing import IO, Any

from gleanery.config import from_flat
from gleanery.plans.scan import PHASES, Cancelled, scan_directory
from gleanery.report.render import to_json

GROUP = "gleanery-scan"


class Service:
    def __init__(self, out: IO[str], spark: Any = None):
        self.out, self.spark, self.lock = out, spark, threading.Lock()
        self.thread: threading.Thread | None = None
        self.stop = threading.Event()

    def tell(self, event: str, **values: Any) -> None:
        with self.lock:
            self.out.write(json.dumps({"event": event, **values}) + "\n")
            self.out.flush()

    def session(self):
        if self.spark is None:
            from gleanery.session import local_session

            self.spark = local_session()
        return self.spark

    def scan(self, path: str, settings: dict | None) -> None:
        stop = self.stop

        def phase(name: str, k: int, of: int) -> None:
            if stop.is_set():
                raise Cancelled
            self.tell("phase", name=name, index=k, total=of)
            self.tell("progress", done=k, total=of)

        try:
            if not os.path.isdir(path):
                raise ValueError(f"not a directory: {path}")
            config = from_flat(settings if settings is not None else {})
            spark = self.session()
            spark.sparkContext.setJobGroup(GROUP, path, True)
            report = scan_directory(spark, path, config, phase)
            body = json.loads(to_json(report)) if not report.empty else {"files": [], "summary": None}
            report.close()
            self.tell("cancelled") if stop.is_set() else self.tell("complete", report=body)
        except Cancelled:
            self.tell("cancelled")
        except Exception as e:  # noqa: BLE001 - a failed scan is an event; the service goes on
            self.tell("cancelled") if stop.is_set() else self.tell("error", message=str(e).splitlines()[0] if str(e) else type(e).__name__)

    def cancel(self, wait: float = 10.0) -> None:
        if self.thread and self.thread.is_alive():
            self.stop.set()
            if self.spark is not None:
                self.spark.sparkContext.cancelJobGroup(GROUP)
            self.thread.join(wait)

    def handle(self, line: str) -> bool:
        """False once the service is to end."""
        try:
            command = json.loads(line)
        except ValueError:
            self.tell("error", message="not a line of JSON")
            return True
        name = command.get("cmd") if isinstance(command, dict) else None
        if name == "shutdown":
            self.cancel()
            return False
        if name == "cancel":
            self.cancel()
        elif name == "scan" and command.get("path"):
            self.cancel()
            self.stop = threading.Event()
            self.thread = threading.Thread(target=self.scan, args=(command["path"], command.get("config")), daemon=True)
            self.thread.start()
        else:
            self.tell("error", message=f"unknown command {name!r}")
        return True


def serve(source: IO[str], out: IO[str], spark: Any = None) -> int:
    service = Service(out, spark)
    service.tell("ready", phases=PHASES)
    for line in source:
        if line.strip() and not service.handle(line):
            return 0
    if service.thread:
        service.thread.join()
    return 0
