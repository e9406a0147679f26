"""Where rejected chunks go."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame


def write_rejects(rejected: DataFrame, path: str) -> None:
    """As JSON lines; the result is distributed and any file system will do."""
    rejected.select("chunk_id", "reason", "text", "metadata").write.mode("overwrite").json(path)


def reject_name(chunk: str, reason: str) -> str:
    """A file name of the chunk and the beginning of the reason."""
    return f"{chunk}_{re.sub('[^A-Za-z0-9 _-]', '', reason[:20])}.md"


def write_viewer(rejected: DataFrame, folder: str) -> int:
    """A report to look at: one JSON list, a script that holds it, and a file per chunk. Streams over the rows."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    with open(f"{folder}/pruning.json", "w") as plain, open(f"{folder}/pruning.js", "w") as script:
        plain.write("[")
        script.write("window.PRUNING_DATA = [")
        for r in rejected.select("chunk_id", "reason", "text", "metadata").toLocalIterator():
            entry = json.dumps({"chunkId": r.chunk_id, "reason": r.reason, "text": r.text, "metadata": r.metadata})
            for f in (plain, script):
                f.write(("," if n else "") + "\n" + entry)
            with open(f"{folder}/{reject_name(r.chunk_id, r.reason)}", "w") as own:
                own.write(f"# {r.reason}\n\n{r.text}\n")
            n += 1
        plain.write("\n]\n")
        script.write("\n];\n")
    return n
