"""Part of gramloom; see README.md."""
