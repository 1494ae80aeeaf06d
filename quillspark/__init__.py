"""quillspark: corpus building, filtering, splitting and scoring as DataFrame operators on Spark."""
