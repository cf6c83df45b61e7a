"""DataFrame operators over extent maps, segments, images, ownership records and audit logs."""
