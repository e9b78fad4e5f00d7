"""Sources and sinks: places, snapshot documents, file trees, objects, job settings."""
