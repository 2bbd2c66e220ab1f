"""Readers and writers: PDB, float32 frames, DCD, job directories, system XML, bundles, reports."""
