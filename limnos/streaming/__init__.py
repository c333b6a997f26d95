"""Incremental ingest with Structured Streaming.

The modelled workflow has no streaming operators (no watermarks, windows
or state): its feeds are whole files.  What does arrive continuously at
scale is *new files* in the raw feed folders, so this package only offers
file-source ingest that runs the same batch cleaning on each new set of
files (``trigger(availableNow=True)``), with progress kept in the shared
checkpoint folder; a batch that is repeated after a failure overwrites its own
output folder, so each file counts once.
"""

from limnos.streaming.ingest import ingest_new_files

__all__ = ["ingest_new_files"]
