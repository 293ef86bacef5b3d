"""A session's events from streaming queries: progress and the end."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener

from tidemark.hooks import Registry


class SessionListener(StreamingQueryListener):
    """Tells hooks of each batch (``download_progress``) and of the query's end (``download_session_completed``)."""

    def __init__(self, hooks: Registry):
        self.hooks, self.rows, self.bytes = hooks, 0, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.bytes += self._bytes(event.progress)
        self.hooks.dispatch("on_event", "download_progress", batch=event.progress.batchId, rows=event.progress.numInputRows, total=self.rows, downloaded=self.bytes)

    @staticmethod
    def _bytes(progress) -> int:
        """What the query counted as ``bytes`` with ``observe("transfer", sum(..).alias("bytes"))``; 0 if it didn't."""
        seen = (progress.observedMetrics or {}).get("transfer")
        return int(getattr(seen, "bytes", None) or 0) if seen is not None else 0

    def onQueryTerminated(self, event) -> None:
        self.hooks.dispatch("on_event", "download_session_completed", rows=self.rows, downloaded=self.bytes, error=event.exception)
