"""Part of cubeframe."""
