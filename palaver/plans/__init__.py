"""Multi-step jobs: assembly, planning and the migration life cycle."""
