"""Complete jobs: business pipelines and lineage analytics over a corpus of scripts."""
