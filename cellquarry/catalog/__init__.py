"""Project folders: manifest, snapshots, views."""
