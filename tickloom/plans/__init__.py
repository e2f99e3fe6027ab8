"""What a run reads and how it is identified: data planning, windows, fingerprints."""
